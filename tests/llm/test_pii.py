"""Surrogates: detection against the patterns in Python, formats, coreference,
distinctness."""

import regex

from ledgerlens.llm.pii import ANY, KINDS, PATTERNS, attempts, replace_entities
from ledgerlens.llm.queries import QUERIES

from .conftest import SF, docs_frame

FIND = regex.compile(regex.sub(r"\\p\{Is", r"\\p{", ANY))


def kind_of(v):
    return next(k for k in KINDS if regex.fullmatch(PATTERNS[k], v))


def luhn(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def split_like(old, new):
    """The surrogates of ``old`` in ``new``: the text between entities is unchanged."""
    gaps, found = regex.split(FIND, old), FIND.findall(old)
    out, at = [], len(gaps[0])
    assert new.startswith(gaps[0])
    for g in gaps[1:]:
        end = new.index(g, at + 1) if g else len(new)
        out.append(new[at:end])
        at = end + len(g)
    assert at == len(new)
    return list(zip(found, out))


def test_query_against_patterns(llm, documents):
    got = {r["doc_id"]: r for r in QUERIES["op8_pii_surrogates"](llm, SF).collect()}
    assert len(got) == len(documents)
    pairs = set()
    for d in documents:
        t, r = d["text"] or "", got[d["doc_id"]]
        spans = [(kind_of(m[0]), m.start(), m.end()) for m in FIND.finditer(t)]
        assert r["entities"] == ",".join(f"{k}:{a}:{b}" for k, a, b in spans) and r["n_entities"] == len(spans)
        pairs |= {(kind_of(o), o, n) for o, n in split_like(t, r["text"])}
    assert len(pairs) > 50 and {k for k, _, _ in pairs} >= {"email", "ip", "card", "phone"}
    assert len({o for _, o, _ in pairs}) == len(pairs) == len({n for _, _, n in pairs})
    assert not {o for _, o, _ in pairs} & {n for _, _, n in pairs}
    for k, o, n in pairs:
        assert k == kind_of(n)
        if k in ("phone", "card"):
            assert regex.sub("[0-9]", "9", o) == regex.sub("[0-9]", "9", n)
        if k == "card":
            assert (luhn(o) % 10 == 0) == (luhn(n) % 10 == 0)


def test_formats_and_coreference(llm):
    rows = [(1, "Call +1 (415) 555-1234 or (415) 555 1234, not +1 (415) 555-1235. Mail Jo.Li2@Corp.Example.COM, jo.li2@corp.example.com"),
            (2, "Card 4111 1111 1111 1111 and 4111111111111111 and 4111-1111-1111-1112; ssn 123-45-6789; host 10.0.0.1, v1.2.3.4.5"),
            (3, "Mrs. Anna Smith met Mr Smith, MR JOHN; Frau Müller; Госпожа Иванова; Κυρία Παππά; Mr. 7"),
            (4, None), (4, ""), (None, "none here: 12345 a@b 1.2.3"), (5, "a" * 100_000 + " x@y.zz"), (3, "same 10.0.0.1")]
    got = sorted(replace_entities(docs_frame(llm, rows), "k1").collect(), key=lambda r: (r["doc_id"] or 0, r["n_entities"], r["text"]))
    assert [r["n_entities"] for r in got] == [0, 5, 5, 1, 6, 0, 0, 1]
    by = {(r["doc_id"], r["n_entities"]): r["text"] for r in got}
    phone = regex.findall(r"\([0-9]{3}\) [0-9]{3}[ -][0-9]{4}", by[1, 5])
    digits = [regex.sub("[^0-9]", "", p) for p in phone]
    assert len(phone) == 3 and digits[0] == digits[1] != digits[2] and by[1, 5].startswith("Call +1 (")
    mails = regex.findall(r"\S+@\S+", by[1, 5])
    assert mails[0].rstrip(",").lower() == mails[1].lower() and "." in mails[1].split("@")[0]
    cards = regex.findall(r"4[0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", by[2, 5])
    assert cards[0].replace(" ", "") == cards[1] and luhn(cards[1]) % 10 == 0 and luhn(cards[2]) % 10
    assert "123-45-6789" not in by[2, 5] and "v1.2.3.4.5" in by[2, 5]
    host = regex.search(r"host ([0-9.]+),", by[2, 5])[1]
    assert by[3, 1] == f"same {host}" and host != "10.0.0.1"
    people = by[3, 6]
    m = regex.match(r"Mrs\. (\w+a) (\w+) met Mr (\w+), MR [A-Z]+; Frau (\w+); Госпожа (\w+); Κυρία (\w+); Mr\. 7$", people)
    assert m and "JOHN" not in people and m[2] == m[3] and regex.match(r"\p{Cyrillic}+$", m[5]) and regex.match(r"\p{Greek}+$", m[6])
    other = {(r["doc_id"], r["n_entities"]): r["text"] for r in replace_entities(docs_frame(llm, rows), "k2").collect()}
    assert other[2, 5] != by[2, 5] and other[None, 0] == by[None, 0] == rows[5][1]
    assert replace_entities(docs_frame(llm, []), "k").count() == 0


def test_planted_numbers_without_prefix(llm):
    """Values written here, not made from the patterns."""
    phones = ["415-555-0134", "415.555.0134", "415 555 0134", "1-415-555-0134", "030 1234567", "030/1234567", "0171.555.0134", "0171 5550134",
              "020 7946 0958", "01 23 45 67 89", "01.23.45.67.89", "044 668 18 00", "0049 30 1234567", "612 345 678", "612-345-678", "91 123 45 67"]
    cards = ["3782 822463 10005", "3714-496353-98431", "3056 930902 5904", "1354 12345 123456", "4111 1111 1111 1111", "378282246310005"]
    free = ["on 01.02.2024 12:30", "2024-01-15 09:30:00", "01/02/2024", "v1.2.3.4.5", "pages 100-200", "1990-2000", "0.12345678", "3.14159 2.71828",
            "1 234 567 890 123", "ISBN 978-3-16-148410-0", "05.06.07", "12345 67", "00:00:01 0012345"]
    rows = [(i, f"x {v}, y") for i, v in enumerate(phones + cards)] + [(100 + i, f"x {v}, y") for i, v in enumerate(free)]
    got = {r["doc_id"]: r for r in replace_entities(docs_frame(llm, rows), "k").collect()}
    for i, v in enumerate(phones + cards):
        kind, new = "phone" if i < len(phones) else "card", got[i]["text"][2:-3]
        assert got[i]["entities"] == f"{kind}:2:{2 + len(v)}" and new != v, v
        assert regex.sub("[0-9]", "9", new) == regex.sub("[0-9]", "9", v) and kind_of(new) == kind, (v, new)
        assert kind == "phone" or (luhn(v) % 10 == 0) == (luhn(new) % 10 == 0)
        assert (v[0] == "0") == (new[0] == "0")
    assert [v for i, v in enumerate(free) if got[100 + i]["n_entities"]] == []


def test_meeting_surrogates_draw_again(llm):
    """Four digits: so few surrogates that many meet."""
    few = llm.createDataFrame([("phone", f"{i:04d}") for i in range(0, 1500)], "kind string, canon string")
    again = {r["canon"]: r["attempt"] for r in attempts(few, "k").collect()}
    from pyspark.sql import functions as F

    from ledgerlens.llm.pii import surrogate
    frame = few.select("canon", F.udf(lambda c: again.get(c, 0), "int")("canon").alias("a"))
    new = [r["n"] for r in frame.select(surrogate("k", F.lit("phone"), F.col("canon"), F.col("a")).alias("n")).collect()]
    assert len(set(new)) == 1500 and not set(new) & {f"{i:04d}" for i in range(1500)} and any(again.values())
