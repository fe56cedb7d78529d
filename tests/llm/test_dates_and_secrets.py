"""Dates in timestamps and with one-digit parts; secrets in texts without digits."""

import pytest

from foilframe.llm.pseudonyms import Feistel, pseudonymise

F = Feistel(b"key")


def test_timestamp_keeps_the_link():
    out, found = pseudonymise("2024-01-05T10:00:00Z and 2024-01-05 10:00", F)
    assert [v["kind"] for v in found] == ["date", "date"] and found[0]["value"] == found[1]["value"] != "2024-01-05"
    assert out[10:24] == "T10:00:00Z and"
    assert pseudonymise(out, F, invert=True)[0] == "2024-01-05T10:00:00Z and 2024-01-05 10:00"


def test_one_digit_parts_year_first():
    found = pseudonymise("on 2024-1-5, on 2024/1/05", F)[1]
    assert [(v["kind"], v["start"]) for v in found] == [("date", 3), ("date", 16)]
    part = lambda v: [int(x) for x in v.replace("/", "-").split("-")]
    assert part(found[0]["value"]) == part(found[1]["value"]) == part(pseudonymise("2024-01-05", F)[1][0]["value"])


@pytest.mark.parametrize("text", ["2024-01-056", "2024-01-05Tea", "2024-01-05x", "2024-13-5", "2024-1-5-6"])
def test_no_dates(text):
    assert pseudonymise(text, F) == (text, [])


@pytest.mark.parametrize("value", ["abcdef-ghijklmnopqrst", "abc+def/ghijklmnopqrst", "abcdefghijklmnopqrst"])
def test_secrets_without_digits(value):
    out, found = pseudonymise(f"api_key = {value}", F)
    assert [v["kind"] for v in found] == ["secret"] and value not in out
