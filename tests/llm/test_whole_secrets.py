"""Secrets in wrapped base64, several members, other encodings and layers with binary parts."""
import base64
import bz2
import gzip
import zlib

import pytest

from intake_spark.llm import secrets

PLAIN = "password=hunter2hunter2"


def wrapped(raw, width, end="\n"):
    text = base64.b64encode(raw).decode()
    return end.join(text[k:k + width] for k in range(0, len(text), width))


noise = bytes((k * 7919 + k * k) % 251 for k in range(400))
LONG = "".join(f"line {k * 7919 % 10007} of a log\n" for k in range(60)) + PLAIN + " and more of it"
CASES = {
    **{f"nul {c!r}": base64.b64encode(f"some {c} text {PLAIN} end".encode()).decode() for c in ("\0", "\x1b", "\x7f", "\x85", "�")},
    "ansi": base64.b64encode(b"\x1b[1mpassword=\x1b[31mhunter2hunter2\x1b[0m").decode(),
    "latin-1": base64.b64encode(f"clé é {PLAIN} à".encode("latin-1")).decode(),
    "utf-16": base64.b64encode(PLAIN.encode("utf-16")).decode(), "utf-16-be": base64.b64encode(PLAIN.encode("utf-16-be")).decode(),
    "binary": base64.b64encode(noise + b"\xff" + PLAIN.encode() + b"\xff" + noise).decode(),
    "gzip of utf-16": base64.b64encode(gzip.compress(PLAIN.encode("utf-16"))).decode(),
    "members": base64.b64encode(gzip.compress(b"nothing") + gzip.compress(PLAIN.encode())).decode(),
    "bz2 members": base64.b64encode(bz2.compress(b"nothing") + bz2.compress(PLAIN.encode())).decode(),
    "wrapped 64": wrapped(b"x" * 35 + b" " + PLAIN.encode() + b" " + b"y" * 50, 64), "wrapped 76": wrapped(b"x" * 45 + b" " + PLAIN.encode() + b" " + b"y" * 51, 76, "\r\n"),
    **{f"wrapped {f.__name__} {f.__module__}": wrapped(f(LONG.encode()), 76) for f in (gzip.compress, zlib.compress, bz2.compress)},
}


@pytest.mark.parametrize("name", CASES)
def test_layer(name):
    for behind in (" after", "\nafter that"):
        text = f"ä before {CASES[name]}{behind}"
        base, spans = secrets.find(text)
        assert not base and any(k == 0 for _, k, _ in spans)
        new = secrets._hidden(text, spans, "[SECRET]")
        assert not secrets.find(new)[1] and new.startswith("ä before [SECRET]")
        assert new.endswith("after" if behind == " after" else "that")


def test_clean_lines_have_no_finds():
    assert secrets.find("\n".join(base64.b64encode(noise[k:k + 45]).decode() for k in range(0, 360, 45)))[1] == []
