"""Pseudonyms: links over formats, a plain version of the whole replacement, odd rows, and time."""

import random
import re
import time

from foilframe.llm import pseudonyms

F = pseudonyms.Feistel(b"key")


def values(text, kind):
    return [v["value"] for v in pseudonyms.pseudonymise(text, F)[1] if v["kind"] == kind]


def test_equal_values_keep_their_link():
    days = values("13/5/2020, 2020-05-13, 13.05.2020 and 5/13/2020; 5/7/2021, 2021-05-07 and 07.05.2021", "date")
    read = [sorted(map(int, re.split(r"\D", d)), reverse=True) for d in days]
    assert len(days) == 7 and read[0] == read[1] == read[2] == read[3] and read[4] == read[5] == read[6] != read[0]
    first, year = re.split(r"\D", days[1]), days[1][:4]
    assert days[0] == f"{int(first[2])}/{int(first[1])}/{year}" and days[3] == f"{int(first[1])}/{int(first[2])}/{year}"
    mails = values("Joe.Smith@x.com joe.smith@x.com JOE.SMITH@X.com joe.smyth@x.com", "mail")
    assert len({m.lower() for m in mails[:3]}) == 1 and mails[3].lower() != mails[0].lower() and mails[0].split("@")[0][0].isupper()
    calls = values("(743) 555-3824, +1 (743) 555-3824, 743.555.3824, +1-743-555-3824, +17435553824, +1 7435553824; +44 20 7946 0958, +442079460958", "phone")
    digits = [re.sub(r"\D", "", c) for c in calls]
    assert len(calls) == 8 and len({d[-10:] for d in digits[:6]}) == 1 and digits[6] == digits[7] and digits[6][:2] == "44" and digits[1][0] == "1"


def test_secrets_do_not_depend_on_the_rest_of_the_text():
    alone = pseudonyms.pseudonymise("password: abcd-efgh-ijkl-mnop-qrst", F)[0]
    assert "abcd-efgh" not in alone
    assert pseudonyms.pseudonymise("password: abcd-efgh-ijkl-mnop-qrst and 1 more", F)[0] == alone + " and 1 more"
    assert pseudonyms.pseudonymise(alone, F, invert=True)[0] == "password: abcd-efgh-ijkl-mnop-qrst"


PARTS = ["token = abcdefghijklmnopqrst", "joe@x.com", "DE89 3704 0044 0532 0130 00", "+1 (743) 555-3824", "743-555-3824", "4111 1111 1111 1111", "4111111111111112", "123-45-6789", "000-12-3456", "70.23.22.57", "300.1.1.1",
         "2024-02-29", "13/5/2020", "5.5.2021", "2023-02-29", "words", "EUR 500", "secret: joe@x.com4111111111111111", "+442079460958", "1", "X"]


def plainly(text):
    """Each kind in turn, each place in turn, held against all that is taken."""
    taken = []
    for kind in pseudonyms.KINDS:
        at = 0
        while at < len(text):
            m = pseudonyms._PATTERNS[kind].match(text, at)
            done = False
            for x in (pseudonyms.iban_tries(m) if kind == "iban" else [m]) if m else []:
                if not any(s < x.end() and x.start() < e for s, e, _ in taken) and (new := pseudonyms.KINDS[kind][1](x, F, False)) is not None:
                    taken.append((x.start(), x.end(), new))
                    at, done = x.end(), True
                    break
            if not done:
                at = m.end() if m and kind != "iban" else at + 1
    out, here = "", 0
    for s, e, new in sorted(taken):
        out, here = out + text[here:s] + new, e
    return out + text[here:]


def test_equals_a_plain_version_and_inverts():
    rng = random.Random(4)
    for _ in range(150):
        text = "".join(rng.choice(PARTS) + rng.choice([" ", ", ", "\n", "; ", " "]) for _ in range(rng.randint(0, 14)))
        out = pseudonyms.pseudonymise(text, F)[0]
        assert out == plainly(text) and pseudonyms.pseudonymise(out, F, invert=True)[0] == text


def test_many_values_take_linear_time():
    text = " ".join(f"name{k}@mail.example.com" for k in range(16000))
    began = time.time()
    out, found = pseudonyms.pseudonymise(text, F)
    assert len(found) == 16000 and len({v["value"] for v in found}) == 16000 and time.time() - began < 20


def test_null_ids_long_texts_and_the_key(spark):
    long = "mail joe@x.com and 123-45-6789. " * 3000
    df = spark.createDataFrame([(None, "joe@x.com", 1), (1, long, 2), (2, None, 3), (None, None, None)], "doc_id long, text string, start int")
    rows = pseudonyms.pseudonymised(df, b"key").collect()
    assert sum(r.doc_id is None for r in rows) == 2 and {len(r.found) for r in rows} == {0, 1, 6000}
    mail = next(r.text for r in rows if r.doc_id is None and r.text)
    assert next(r.text for r in rows if r.doc_id == 1).count(mail) == 3000
    assert {r.text for r in pseudonyms.pseudonymised(df, b"other").collect()} != {r.text for r in rows}
