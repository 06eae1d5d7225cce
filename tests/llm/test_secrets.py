"""Secret scan against a plain-Python version and the SQL."""

import hashlib
import re

import duckdb

from ledgerlens.llm.queries import ORACLES, QUERIES
from ledgerlens.llm.secrets import scan_secrets

from .conftest import SF, docs_frame

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_by_hand(t):
    t = t or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    order = ["assign", "access", "hex"]
    return sorted(out, key=lambda x: (x[1], order.index(x[0])))


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check(rows, got):
    for t, r in zip(rows, got):
        want = base_by_hand(t)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[0] == k for x in want) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(listed(want).encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x.split(":")[0] in ("assign", "access", "hex")] == [
            f"{k}:{a}:{b}" for k, a, b in want]


def test_query_against_hand_and_sql(llm, documents):
    got = {r["doc_id"]: r for r in QUERIES["op5_secret_scan"](llm, SF).collect()}
    check([d["text"] for d in documents], [got[d["doc_id"]] for d in documents])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLES["op5_secret_scan"]).df().to_dict("records")
    assert {r["doc_id"]: r for r in want} == {i: r.asDict() for i, r in got.items()} and len(want) == len(got)


KEY = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
ACCESS = "AKIA" + "ABCDEFGH12345678"


def test_base_spans_and_linking(llm):
    texts = [
        f"é𝄞 id {ACCESS}\n{KEY}\nhttps://db.example.com/x done",          # all parts together
        f"only {KEY} here", "only https://db.example.com/x here",           # weak parts alone
        f"{ACCESS}" + " filler" * 60 + f" {KEY}",                           # out of scope
        f"{KEY} goes to mysql://u@h.example.com:33/db",                     # two weak parts
        "secret:token =abcdefgh token=abc PASSWORD = 'x1.y2-z3' ApiKey:\"qwerty\" Api_Key=12345",
        "0123456789abcdef01234567 0123456789abcdef0123456 AKIA12 " + "ab" * 40, "", None, "ſecret=abcdefgh Key",
        f"token={KEY}", "a" * 100_000 + " " + "deadbeef" * 3, "token=" + "abcdefg " * 1 + "token=hijklmn " * 3000]
    got = sorted(scan_secrets(docs_frame(llm, list(enumerate(texts)))).collect(), key=lambda r: r["doc_id"])
    check(texts, got)
    weak = [[x.split(":")[0] for x in r["spans"].split(",") if x.startswith(("key", "endpoint"))] for r in got]
    assert weak[:5] == [["key", "endpoint"], [], [], [], ["key", "endpoint"]] and weak[10] == []
    assert got[0]["spans"] == f"access:6:26,key:27:{27 + len(KEY)},endpoint:{28 + len(KEY)}:{52 + len(KEY)}"
    assert [r["n_linked"] for r in got][:5] == [2, 0, 0, 0, 2]
    twice = scan_secrets(docs_frame(llm, [(1, texts[0])] * 2 + [(None, None)])).collect()
    assert sorted(r["n_access"] for r in twice) == [0, 1, 1] and scan_secrets(docs_frame(llm, [])).count() == 0


def weak_by_hand(t, scope=200):
    """Weak spans from all pairs of a document's parts."""
    base = base_by_hand(t)
    weak = [("endpoint", m.start(), m.end()) for m in
            re.finditer("(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp|ftp)://[A-Za-z0-9.:@/_%+~?=&#-]+", t) if len(m[0]) >= 12]
    weak += [("key", m.start(), m.end()) for m in re.finditer("[A-Za-z0-9+/_-]{32,}={0,2}", t)
             if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])]
    weak = [w for w in weak if not any(b <= w[1] < e for _, b, e in base)]
    fits = {"key": ("access", "assign", "endpoint"), "endpoint": ("access", "assign", "key")}
    return sorted(((k, a, b) for k, a, b in weak if any(
        o in fits[k] and e >= a - scope and s <= b + scope for o, s, e in base + weak)), key=lambda x: (x[1], x[0] == "key"))


def test_long_keys_other_alphabets_and_gaps(llm):
    long = "aB3" * 29 + "x"                                                     # 88 characters
    url_key = "wJalr-XUtnFEMI_K7MDENG-bPxRfiCY_EXAMPLEKEY0=="
    address = "https://h.example.com/" + "a" * 300
    texts = [f"{ACCESS} {long}", f"{ACCESS} {url_key} x", f"{ACCESS} {'aB3' * 50_000}", f"{address} {KEY}",
             f"{KEY} " + "f " * 99 + ACCESS, f"{KEY} " + "f " * 101 + ACCESS, f"{ACCESS} " + "f " * 99 + KEY, f"{ACCESS} " + "f " * 101 + KEY,
             f"{address}{KEY}", f"{long}{url_key}", f"KEY={KEY}= and\n" * 300 + f"{ACCESS}\n" + f"{address}\n" * 300]
    got = sorted(scan_secrets(docs_frame(llm, list(enumerate(texts)))).collect(), key=lambda r: r["doc_id"])
    check(texts, got)
    for t, r in zip(texts, got):
        assert [x for x in r["spans"].split(",") if x.startswith(("key", "endpoint"))] == [f"{k}:{a}:{b}" for k, a, b in weak_by_hand(t)]
    assert f"key:21:{21 + 88}" in got[0]["spans"] and f"key:21:{21 + len(url_key)}" in got[1]["spans"] and "key:21:150021" in got[2]["spans"]
    assert [r["n_linked"] for r in got][3:8] == [2, 1, 0, 1, 0]
