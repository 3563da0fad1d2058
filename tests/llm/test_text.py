import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from harborlight.llm import consistent as C
from harborlight.llm import leakage, pii

LONG = "plain words " * 40_000


def test_consistent_form():
    cases = {
        "Ｆｕｌｌ ｗｉｄｔｈ": "Full width", "oﬃce": "office", "café": "café", "su​m­": "sum", "a b c": "a b c", "Vuɡi": "Vugi", "bаnk": "bank",
        "Русский": "Русский", "Ελληνικά": "Ελληνικά", "señor’s “x” — y": "señor’s “x” — y", "Русский": "Русский", "x² ½": "x² ½", "": "", "e‍́": "é",
    }
    assert {k: C.consistent(k) for k in cases} == cases
    assert C.consistent(None) is None and C.consistent(LONG) == LONG


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abé ñ́̃​ ﬁＡаойɡ\n.") + ["가", "ᅡ"]), max_size=40))
def test_consistent_is_stable_and_offsets_fit(text):
    out = C.consistent(text)
    assert C.consistent(out) == out
    form, at = C.consistent_with_offsets(text)
    assert form == out and (at is None or (len(at) == len(out) and all(0 <= i < len(text) for i in at) and at == sorted(at)))
    assert unicodedata.is_normalized("NFC", out)


def test_deceptive_records(spark):
    df = spark.createDataFrame([(1, "bаnk", "x"), (1, "bаnk", "x"), (2, "bank", "y"), (3, None, "z"), (None, "bаnk", "z"), (4, "", "z"), (5, "niño — “ok”", None)], "complaint_id long, t string, field_name string")
    got = C.deceptive_records(df, "complaint_id", "t", "f")
    assert [tuple(r) for r in got.collect()] == [("f", 1)]
    assert C.deceptive_records(df.limit(0), "complaint_id", "t", "f").count() == 0
    kept = {r.complaint_id: r.c for r in C.with_consistent(df, "t", "c").collect()}
    assert kept[1] == "bank" and kept[3] is None and kept[4] == "" and kept[5] == "niño — “ok”"


ITEM = "Case 448. the sister of a florist bought a violet bicycle in Quin for 582 coins while a clerk at the fairground misread 24 digits"


def test_leaks_with_offsets(spark):
    words = ITEM.split()
    part = " ".join(words[3:15])
    docs = [
        (1, "before " + part + " after"), (2, " ".join(words[3:14])), (3, ("* ".join(words[3:15])).upper()), (4, "x " + part.replace("sister", "si​ster").replace("florist", "flоrist") + " y"),
        (5, None), (6, ""), (7, LONG + ITEM), (1, "before " + part + " after"), (8, "\n> ".join(words[3:16])), (9, " ".join(w + (" lately" if i % 6 == 5 else "") for i, w in enumerate(words))),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as k", "2 as item_id")
    items = spark.createDataFrame([(220, ITEM), (1, None), (2, "too short"), (3, "")], "item_id long, text string")
    got = leakage.leaked_passages(d, "doc_id", "text", items, "item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 220), (3, 220), (4, 220), (7, 220), (8, 220)}
    first = next(r for r in got if r.doc_id == 1)
    assert docs[0][1][first.start : first.end] == part and first.n_words == 12
    four = next(r for r in got if r.doc_id == 4)
    assert docs[3][1][four.start : four.end].startswith("si​ster")
    assert leakage.leaked_passages(d, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert leakage.leaked_passages(d.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0


TEXTS = {
    "write to noor.fenwalio (at) example [dot] com or MEI.X@example.org. It was": {"email"},
    "elkuby-517 at example dot org please": {"email"}, "meet me at noon. My dog": set(),
    "Call me at (251) 555-0170 ext. 28.": {"phone"}, "They typed my SSN as 975.21.1126.": {"ssn"}, "SSN 914397747. 19 pulls": {"ssn"},
    "card no. 9313055290837878 is": {"card"}, "card no. 9313055290837879 is": set(), "Account number 4505550121 is mine": {"account"}, "Account ending XXXX": set(),
    "I live at 1414 pinecroft street, unit 12 and": {"address"}, "They listed 72 South Ashby Ct Apt 4B and": {"address"}, "We work 3 days a week on the way": set(),
    "A supervisor named James Lundenby and": {"name"}, "I spoke with Trewase Tufrux Mortgage Inc. on": set(), "I spoke with Mr. XXXX who": set(), "Mrs. Morvotov signed": {"name"},
    "PURCHASES LOST THE GRACE PERIOD": set(), "my name is priya gravewick and i": {"name"}, "My name is being dragged": set(), "Under 15 U.S.C. 1681 on 12/01/2020 for $1,234.00": set(),
}


def test_detection_and_placeholders():
    assert {t: {k for _, _, k, _ in pii.spans(t)} for t in TEXTS} == TEXTS
    for t in TEXTS:
        assert pii.redact(pii.redact(t)) == pii.redact(t)
    assert pii.redact("SSN 975-21-1126, ok") == "SSN [SSN], ok"
    assert pii.spans(None) == [] and pii.redact("") == "" and pii.spans(LONG) == []
    hidden = "my SSN as 975​.21.1126 x"
    assert pii.redact(hidden) == "my SSN as [SSN] x"


def test_surrogates(spark):
    rows = [
        (1, "A supervisor named James Lundenby called. Mr. Lundenby refused. Call me at 251-555-0170."), (2, "An agent called JAMES LUNDENBY again"), (3, "card no. 9313 0552 9083 7878 is"),
        (4, None), (5, "nothing here"), (6, ""), (5, "nothing here"),
    ]
    df = spark.createDataFrame(rows, "complaint_id long, t string").selectExpr("complaint_id", "t", "'x' as k", "7 as edits")
    texts, found = pii.pseudonymised(df, "complaint_id", "t", b"key")
    out = {}
    for r in texts.collect():
        out.setdefault(r.complaint_id, []).append((r.text_placeholder, r.text_surrogate))
    assert out[1][0][0] == "A supervisor named [NAME] called. Mr. [NAME] refused. Call me at [PHONE]."
    surname = out[1][0][1].split()[4]
    assert f"Mr. {surname} refused" in out[1][0][1] and surname.upper() in out[2][0][1]  # one person, one surrogate, whatever the case
    assert "Lundenby" not in out[1][0][1] and "251-555-0170" not in out[1][0][1]
    digits = "".join(c for c in out[3][0][1].split("no. ")[1] if c.isdigit())
    assert len(digits) == 16 and pii.luhn(digits)
    assert out[4] == [(None, None)] and out[5] == [("nothing here",) * 2] * 2 and out[6] == [("", "")]
    assert {(r.complaint_id, r.pii_type) for r in found.collect()} == {(1, "name"), (1, "phone"), (2, "name"), (3, "card")}
    assert pii.pseudonymised(df.limit(0), "complaint_id", "t", b"key")[0].count() == 0


def test_surrogates_are_distinct(spark):
    parts = [("initial", "a")] + [("ssn", f"{i:09d}") for i in range(300)] + [("given_f", n.lower()) for n in pii.FEMALE]
    df = spark.createDataFrame([([c], [p]) for c, p in parts], "cls array<string>, part array<string>")
    got = pii.surrogates(df, b"k").collect()
    assert len(got) == len(parts) and len({(r.cls, r.surrogate) for r in got}) == len(parts)
