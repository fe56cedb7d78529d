"""IBANs that are followed by capitals or digits."""

import pytest

from foilframe.llm.pseudonyms import Feistel, _iban_check, pseudonymise

F = Feistel(b"key")
DE, GB = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"


def spans(text):
    out, found = pseudonymise(text, F)
    assert pseudonymise(out, F, invert=True)[0] == text
    return [(v["start"], len(v["value"])) for v in found if v["kind"] == "iban"], out


@pytest.mark.parametrize("value, rest", [(DE, " EUR 500"), (DE.replace(" ", ""), " BIC COBADEFF"), (GB, " I"), (GB, " I AM 7"), (DE, ""), (DE, ", EUR")])
def test_ends_at_the_country_length(value, rest):
    got, out = spans(f"to {value}{rest} now")
    assert got == [(3, len(value))] and value not in out and out.endswith(f"{rest} now")
    assert out[3 : 3 + len(value)] == pseudonymise(value, F)[0]


def test_second_value_inside_the_span():
    assert spans(f"{DE} {GB}")[0] == [(0, len(DE)), (len(DE) + 1, len(GB))]
    assert spans(f"AB12 CDEF 0000 {GB} X")[0] == [(15, len(GB))]


def test_unknown_country_and_other_lengths():
    body = "1234 5678 9012 3456"
    value = f"ZZ{_iban_check('ZZ', body.replace(' ', ''))} {body}"
    assert pseudonymise(f"{value} EUR", F)[1][0]["kind"] == "iban"
    long = "370400440532013000ABCD"  # DE, but not of its length
    whole = f"DE{_iban_check('DE', long)}{long}"
    assert spans(whole)[0] == [(0, len(whole))]


def test_what_fails_stays():
    assert spans("DE88 3704 0044 0532 0130 00 EUR 500")[0] == []


def test_longer_ones_invert_where_a_shorter_one_could_be_seen():
    for k in range(400):
        body = f"{k:018d}AB12"
        check = _iban_check("DE", body)
        value = f"DE{check}{body[:18]} AB12"
        if _iban_check("DE", body[:18]) != check:
            assert spans(value)[0] == [(0, len(value))]
