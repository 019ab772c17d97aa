"""Explicit schemas of every table that enters or leaves the engine."""

from __future__ import annotations

TRAIN = ("request_id string, request_text string, channel string, product_family string, warranty_status string, "
         "created_at_ist timestamp_ntz, source string, team_label string")
RESOLUTION_LOG = "request_id string, first_team string, final_team string, transfers int, resolved_at timestamp_ntz"
TEST = ("request_id string, request_text string, channel string, product_family string, warranty_status string, "
        "created_at_ist timestamp_ntz, source string")
TEAM_DIM = "team string, renamed_to string, handles string"
SAMPLE = "request_id string, team string"
CORRECTIONS = ("logged_at timestamp_ntz, request_id string, request_text string, product_family string, team string, "
               "confirmed_at timestamp_ntz")
FEEDBACK = "request_id string, request_text string, product_family string, team string"
REVIEW_QUEUE = ("logged_at timestamp_ntz, request_id string, request_text string, product_family string, "
                "router_team string, route_type string, confidence double")
PARAPHRASES = "source string, family string, paraphrase string"
REWRITTEN = "request_id string, text string, hinglish string, product_family string, final_team_cur string"
