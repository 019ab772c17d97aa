"""A small request history for tests, made from the patterns' own words."""
from intake_spark import lexicon as L

#: (team, sentence with the product, how often a closed request reads like it)
SENTENCES = [
    ("Product Advice", "recipe book for the {}", 6), ("Product Advice", "which mode of the {} is quiet", 5),
    ("Repairs", "sparks from the {} socket", 9), ("Repairs", "{} display gone blank at night", 7), ("Repairs", "fault light on the {}", 4),
    ("Repairs", "{} stuck at one speed", 6),
    ("Billing", "coupon did not work for the {}", 8), ("Billing", "double charge on the {} order", 5),
    ("Warranty Claims", "register my {} online", 6), ("Warranty Claims", "guarantee of the {} runs out when", 5),
    ("Filters & Consumables", "amc renewal of the {}", 6), ("Filters & Consumables", "new jar for the {}", 4), ("Filters & Consumables", "brush for the {} needed", 4),
    ("Installs & Demo", "wall mount of the {} pending", 7),
    ("Returns & Replacement", "missing parts in the {} box", 6), ("Returns & Replacement", "{} came with a torn seal, want exchange", 5),
]
KINDS = ["water purifier", "mixer grinder"]
UNCLEAR_COUNTS = {"Repairs": 13, "Product Advice": 4, "Billing": 6}
UNCLEAR = [v for v in L.VAGUE_PHRASES if v.endswith(" P")]
PARAPHRASES = [
    ("double charge on the P order", "statement lists two debits for the mixer grinder"),
    ("wall mount of the P pending", "nobody put the water purifier up yet"),
]


def history_rows():
    """(request_id, text, final team, first team, product family)."""
    rows = []
    for i, (team, sentence, times) in enumerate(SENTENCES):
        for j in range(2 * times):
            lead = "urgent: " if (i + j) % 3 == 0 else "please help - " if j % 5 == 1 else ""
            paid = j % 4 == 3
            rows.append((lead + sentence.format(KINDS[j % 2]) + (" payment done" if paid else ""), team, "Billing" if paid else team))
    for i, phrase in enumerate(UNCLEAR):
        for team, times in UNCLEAR_COUNTS.items():
            rows += [(phrase[:-1] + KINDS[(i + t) % 2], team, "Repairs") for t in range(times)]
    return [(f"SR{n:06d}", text, team, first, KINDS[n % 2].title()) for n, (text, team, first) in enumerate(rows)]
