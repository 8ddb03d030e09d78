import random
import re

from casewatch.llm import contextual_pii as pii

# the formats as the contract states them, for Python's engine
FORMATS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
EDGE = [
    "", None, "a@b.c_d@e.f g@h", "x..y@mail.example.com,z@q.de. @no.pe", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.255 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1111, 4111111111111112", "4465758382889437 4465758382889437", "+1 (743) 555-3824 +12 +",
    "ünï +49 30 901820 é 10.0.0.1", "1" * 400, "+1" * 50, "a" * 5000 + "@b.cc", "😀 me@x.org 😀 8.8.8.8",
]


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def wanted(text):
    out = []
    for kind, pattern in FORMATS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                    "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, base string, n_chars long")


def test_formats_equal_brute_force(spark):
    got = {r.doc_id: r.spans for r in pii.report(frame(spark, EDGE)).collect()}
    assert got == {i: wanted(t) for i, t in enumerate(EDGE)}
    assert pii.report(frame(spark, EDGE).limit(0)).count() == 0


def test_contexts_of_seeds_find_other_identifiers(spark):
    texts = [f"please contact me at user{i}@mail.example.com today" for i in range(8)]
    texts += ["Please contact me at k7421-xq, thanks", "the year at 2020 was long", "room number 4711x is free"]
    got = {r.doc_id: r for r in pii.report(frame(spark, texts)).collect()}
    start = texts[8].index("k7421")
    assert got[8].spans == f"id:{start}:{start + 8}"
    assert all(got[i].n_id == 0 for i in got if i != 8)


def test_phones_or_spaced_cards_alone_seed_a_context(spark):
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "6011 0000 0000 0004"]
    texts = [f"reach us on +1 (017) 555-77{i}3 now" for i in range(4)] + [f"charged to card {c} today" for c in cards]
    texts += ["reach us on k7421-xq, thanks", "charged to card zz81-4420 once", "the year at 2020x was long"]
    got = [r for r in sorted(pii.report(frame(spark, texts)).collect(), key=lambda r: r.doc_id)]
    start = [t.find(w) for t, w in zip(texts[7:], ("k7421", "zz81"))]
    assert sum(r.n_phone for r in got) == 4 and sum(r.n_card for r in got) == 3
    assert [r.spans for r in got[7:]] == [f"id:{start[0]}:{start[0] + 8}", f"id:{start[1]}:{start[1] + 9}", ""]
    assert not any(r.n_id for r in got[:7])


def test_redaction(spark):
    docs = frame(spark, ["write a@b.cc or 10.0.0.1!", None, "nothing", "+1 (743) 555-3824"])
    out = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert [out[i].text for i in range(4)] == ["write [EMAIL] or [IP]!", None, "nothing", "[PHONE]"]
    assert out[0].n_chars == len(out[0].text) and out[2].n_chars == 1 and pii.redacted(docs).columns == docs.columns


def test_repeated_rows_stay(spark):
    docs = spark.createDataFrame([(1, "a@b.cc"), (1, "a@b.cc"), (None, None)], "doc_id long, text string")
    assert sorted(str(r.text) for r in pii.redacted(docs).collect()) == ["None", "[EMAIL]", "[EMAIL]"]
    assert pii.report(docs).count() == 3


def test_long_matches_leave_the_executor_alive(spark):
    # a greedy group took a stack frame a repetition: such a text ended the process
    texts = ["1" * 20_000, "7 " * 20_000, "3-" * 20_000 + "4", "a@b" + ".c" * 20_000, "+1 (743) 555-3824 me@x.org"]
    got = {r.doc_id: r.spans for r in pii.report(frame(spark, texts)).collect()}
    assert got == {i: wanted(t) for i, t in enumerate(texts)}


def test_many_matches_in_one_text(spark):
    # every word carried a copy of all spans of its text: 20,000 did not end in 120 s, 6,000 ended a process with 1800 MB of heap
    texts = [" ".join(f"user{i}@mail.example.com" for i in range(20_000)), " ".join(f"10.{i % 200}.{i // 200}.7" for i in range(20_000))]
    got = {r.doc_id: r for r in pii.report(frame(spark, texts)).collect()}
    assert [got[i].spans for i in range(2)] == [wanted(t) for t in texts]
    assert got[0].n_email == got[1].n_ip == 20_000 and not got[0].n_id and not got[1].n_id


def test_places_of_matches_beyond_one_block(spark):
    for n in (1, pii.BLOCK - 1, pii.BLOCK, pii.BLOCK + 1, 3 * pii.BLOCK + 5):
        text = "é " + " 😀 ".join(f"{i}.1.1.1" for i in range(n))
        got = pii.base_spans(frame(spark, [text]).select("text")).collect()[0].base
        assert [(b.start, b.end) for b in got] == [m.span() for m in re.finditer(r"[0-9]+\.1\.1\.1", text) if int(m[0][:-6]) <= 255]


def test_spans_at_words_equal_brute_force(spark):
    parts = ["1234@x.yz", "+1 (555) 123 4567", "4111 1111 1111 1111", "10.0.0.1", "k42", "at", "a@b.cc,c@d.ee", "%@x.yz", "4111 1111 1111 1111.1.1.1", "@"]
    draw = random.Random(5)
    texts = ["".join(draw.choice(parts) + draw.choice([" ", " ", ",", "  ", ""]) for _ in range(draw.choice([1, 4, 30]))) for _ in range(200)]
    for r in pii.within_spans(pii.candidates(pii.base_spans(frame(spark, texts).select("text")))).collect():
        assert [(w.start, w.m) for w in r.words] == [(m.start(), m[0]) for m in re.finditer(r"\S*[0-9@]\S*", r.text)]
        for w in r.words:
            begin = [(b.start, b.m) for b in r.base if w.start <= b.start < w.start + len(w.m)]
            assert (w.whole and tuple(w.whole)) == min(begin, default=None)
            assert w.reach == max((b.end for b in r.base if b.start < w.start), default=0)
