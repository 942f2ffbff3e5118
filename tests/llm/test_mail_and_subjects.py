import random

import pytest

from tidewrack.llm.mailspans import authored_text, decode, unauthored_lines
from tidewrack.llm.subjects import document_subjects

MAIL = """Hi Ann,

I read the draft twice and liked it.
From: here on it gets harder, I fear.
-- that is, if Bob agrees --

On 2025-05-15 04:52, Bob Stone wrote:
> Why does it turn?
> On 2025-05-14, Ann wrote:
>> Because.
It does not turn at all, I think.

Best regards are due to Ann for the tip.

Kind regards
Eve Hill
T +00 555 7043
Editor | Hill Press
https://hill.example

This message is confidential and meant only for the addressee. If it reached
you by mistake, destroy all copies."""
KEPT = ["Hi Ann,", "I read the draft twice and liked it.", "From: here on it gets harder, I fear.", "-- that is, if Bob agrees --", "It does not turn at all, I think.", "Best regards are due to Ann for the tip."]
FORWARD = "See below, it helps.\n\n-- \nEve\n\n-----Original Message-----\n*From:* Bob <b@h.example>\n*Sent:* 22.03.2025 19:22\n*To:* e@h.example\n\nThe old text had several sentences. It went on.\nAnd on, in another paragraph."


def kept(t):
    return [s for s, k in zip(t.split("\n"), decode(t)) if k == "authored" and s.strip()]


def test_spans():
    assert kept(MAIL) == KEPT
    assert kept(FORWARD) == ["See below, it helps."]
    assert kept("Guten Tag,\nwir kommen morgen.\n\nAm 1.2.2025 um 10:11 schrieb\nAnn Hill <a@h.example>:\n| alt\nViele Grüße\nEve") == ["Guten Tag,", "wir kommen morgen."]
    assert kept("only this line") == ["only this line"]
    assert decode("") == ["authored"]
    assert len(decode("a line of text.\n" * 3000)) == 3001


BODY = ["The ferry left an hour late and nobody on the quay knew why.", "We counted the crates twice, and twice one was missing.", "", "It turned up in the hold of another boat, under nets."]
SIGNED = ["Kind regards", "Bob Stone", "T +00 555 7043", "Editor | Hill Press"]


@pytest.mark.parametrize("n", [6, 10, 50, 199, 500])
@pytest.mark.parametrize("end", [[], SIGNED, [*SIGNED, "", "This message is confidential and meant only for the addressee. If it reached", "you by mistake, destroy all copies."]])
def test_long_forwards_stay_quoted(n, end):
    body = [BODY[i % 4] for i in range(n)]
    for gap in ([], [""]):
        head = ["From: Bob Stone <b@h.example>", "Sent: 22.03.2025 19:22", "To: e@h.example", "Subject: Crates", *gap]
        assert kept("\n".join(["See below, it helps.", "", *head, *body, *end])) == ["See below, it helps."]
        assert kept("\n".join([*head, *body, *end, *body[:9]])) == []
    # several signed mails in one forward, and a notice in its middle
    assert kept("\n".join(["So.", "", *head, *[s for _ in range(6) for s in [*body, *end, ""]]])) == ["So."]


def test_text_after_the_end_of_a_forward_is_new():
    text = "\n".join(["-----Original Message-----", "From: Bob <b@h.example>", "Sent: 22.03.2025", "", *BODY * 20, "----- End forwarded message -----", "", "I agree with all of it."])
    assert kept(text) == ["I agree with all of it."]


def test_mail_query(spark):
    df = spark.createDataFrame([(1, MAIL, "x"), (2, None, "x"), (3, "", "x"), (4, FORWARD, "x"), (4, FORWARD, "x")], "delivery_id bigint, text_body string, kind string")
    lines = MAIL.split("\n")
    got = {r.line_no for r in unauthored_lines(df).collect() if r.delivery_id == 1}
    assert got == {k for k, s in enumerate(lines, 1) if s.strip() and s not in KEPT}
    assert {r.delivery_id for r in unauthored_lines(df).collect()} == {1, 4}
    assert unauthored_lines(df.limit(0)).count() == 0
    assert {r.delivery_id: r.authored for r in authored_text(df).collect()}[4] == "See below, it helps."


TOPICS = {"law": "court judge appeal verdict statute tribunal", "music": "choir violin concert chord soprano rhythm", "sport": "striker goalkeeper medal league referee stadium"}


def _text(r, subjects, n, everyday=3):
    lines = [" ".join(r.choices(TOPICS[r.choice(subjects)].split(), k=4)) + f" near Place{r.randint(0, 10**6)}." for _ in range(n)] if subjects else []
    lines += [f"It took {r.randint(2, 90)} days until the letter felt quiet." for _ in range(everyday)]
    r.shuffle(lines)
    return " ".join(lines)


def test_held_out_accuracy(spark):
    r = random.Random(1)
    docs, truth = [], {}
    for i in range(700):
        subjects = r.choice([["law"], ["music"], ["sport"], ["law", "music"], []])
        t = _text(r, subjects, 8)
        if subjects and r.random() < 0.3:
            t += " " + _text(r, [r.choice([s for s in TOPICS if s not in subjects])], 1, 0)
        docs.append((i, t))
        truth[i] = set(subjects)
    labels = [(i, s, "rater") for i in range(0, 300) for s in truth[i]]
    labels += [(1000, "law", "r"), (None, "law", "r"), (5, None, "r"), (6, "unknown", "r")]
    docs += [(2000, None), (2001, ""), (2002, "court judge appeal. " * 5000)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("doc_id", "text", "'clash' as subject")
    lab = spark.createDataFrame(labels, "doc_id bigint, subject string, rater string")
    sub = spark.createDataFrame([(s,) for s in TOPICS], "subject string")
    got = {}
    for x in document_subjects(d, lab, sub).collect():
        got.setdefault(x.doc_id, set()).add(x.subject)
    held = range(300, 700)
    assert sum(got.get(i, set()) == truth[i] for i in held) >= 0.93 * len(held)
    assert got[2002] == {"law"} and 2000 not in got and 2001 not in got
    assert document_subjects(d, lab.limit(0), sub).count() == 0
    assert document_subjects(d.limit(0), lab, sub).count() == 0
