import hashlib
import re
import time

import pytest

from textloom.llm import queries as Q
from textloom.llm import secrets as S

TABLES = "/root/testdata/sf0.01"
ASSIGN = re.compile("(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else "_?" for c in w) for w in (
    "password", "passwd", "secret", "token", "api_key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    """The fixed patterns, written anew."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def literals(text):
    return [(text[s["start"]:s["end"]], s["name"]) for s in S.scan_text(text) if s["kind"] == "literal"]


@pytest.mark.parametrize("text, expected", [
    ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"### x', [("24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "token")]),
    ('const K = "s3cr3t-Zx9!qq";\nlet n = 5;\nconfig.dbPassword = K;', [("s3cr3t-Zx9!qq", "config.dbPassword")]),
    ('a = "Qw8!zzR4tt"\nb = a\nprivate_key: str = b', [("Qw8!zzR4tt", "private_key")]),
    ("db:\n  password: hunter2abc\n  user: bob", [("hunter2abc", "password")]),
    ('{"api-key": "AbC123xyZ987", "name": "Bob Smith"}', [("AbC123xyZ987", "api-key")]),
    ('os.environ["DB_PASSWORD"] = "p@ss" + "W0rd99"', [("p@ss", "DB_PASSWORD"), ("W0rd99", "DB_PASSWORD")]),
    ("<password>Tr0ub4dor&3 </password> <user>bob</user>", [("Tr0ub4dor&3", "password")]),
    ("A=abc123XYZ\nTOKEN=${A}_tail99", [("abc123XYZ", "TOKEN"), ("_tail99", "TOKEN")]),
    ('tok = later\nsecret = tok\nlater = "Zz9#kkQ1pp"', [("Zz9#kkQ1pp", "secret")]),
    ('K = "first-Value1"\nsecret = K\nK = "other-Value2"', [("first-Value1", "secret")]),
    ('connect(user="bob", password="B0b$secret1")', [("B0b$secret1", "password")]),
    ('password = getPassword("x")', []), ('password = "changeme"', []), ("the secret: nothing matters here", []),
    ('token_type = "Bearer1234"', []), ("a = a\npassword = a", []), ('url = "http://a.b/c"', []),
    ("password = password\nsecret = secret", []),
])
def test_literals(text, expected):
    assert literals(text) == expected


def test_query_on_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in Q.op11_secrets(spark, TABLES).collect()}
    assert got.keys() == texts.keys()
    held = 0
    for doc, text in texts.items():
        expected = base(text)
        held += len(expected)
        kinds = [k for k, *_ in expected]
        r = got[doc]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        joined = [f"{k}:{a}:{b}" for k, a, b in expected]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        spans = [s for s in r["spans"].split(",") if s]
        assert [s for s in spans if not s.startswith("literal:")] == joined
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), S.KINDS.index(s.split(":")[0])))
    assert held


def test_base_letters_and_lengths():
    for text in ("toKen = abcdef", "paſsword = abcdef", "TOKEN:abcde", "Api_Key='AbCdEf", "x" * 10 + "AKIA" + "Z" * 16,
                 "AKIA" + "Z" * 15, "a" * 24 + "g" + "b" * 23, "token = token = abcdef", "apikey=a.b-c_d"):
        assert [(s["kind"], s["start"], s["end"]) for s in S.scan_text(text) if s["kind"] != "literal"] == base(text)


@pytest.mark.parametrize("unit", ["a.", "a =", 'a="', "k=v+", 'password="', "password:", "${", 'p="${a}', "<a> ", "a = b\n",
                                  "token ", 'b=b+"x1Yz99"\n'])
def test_long_texts_take_linear_time(unit):
    started = time.time()
    S.scan_text("token " + unit * (600_000 // len(unit)) + "\npassword = b")
    assert time.time() - started < 20


def test_odd_rows(odd, empty):
    found = S.scan_secrets(odd)
    assert found.count() == odd.count() and found.where("spans is null").isEmpty()
    assert S.scan_secrets(empty).isEmpty()
