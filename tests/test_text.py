import sqlite3
import unicodedata

from pyspark.sql import functions as F

from textloom.functions.porter import stem_tokens, stem_word
from textloom.functions.text import fold, tokenize, tokenize_str

CASES = [
    "Hello, World_2 foo-bar", "Café RÉSUMÉ naïve", "élégant", "İstanbul",
    "ǖ Ệ œuvre ß ﬁn", "Ⅷ ½ ² १२", "世界 你好", "a.b@c.d it's", "x ́y", "",
    "ΣΑΣ σας", "tab\tnew\nline", "C++ a+b", "ﬁ", "ſpeed µm",
]


def test_tokens_match_full_text_tokenizer(spark, fulltext):
    rows = spark.createDataFrame(list(enumerate(CASES)), "id int, text string")
    got = {r["id"]: r["t"] for r in rows.select("id", tokenize("text").alias("t")).collect()}
    for i, text in enumerate(CASES):
        assert got[i] == tokenize_str(text) == fulltext.tokens(text), text


def test_document_tokens(documents, fulltext, texts):
    got = dict(documents.select("doc_id", tokenize("text")).collect())
    for doc_id in sorted(texts)[:60]:
        assert got[doc_id] == fulltext.tokens(texts[doc_id])


def test_fold_of_single_letters(spark):
    letters = [chr(c) for c in range(0x41, 0x530)
               if unicodedata.category(chr(c))[0] in "LN"] + [chr(c) for c in range(0x1E00, 0x1F00)]
    # Letters whose case pairs came with later versions of Unicode.
    letters = [c for c in letters if ord(c) not in (0x37F, 0x528, 0x52A, 0x52C, 0x52E)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='unicode61')")
    con.execute("create virtual table v using fts5vocab(t, 'instance')")
    con.executemany("insert into t(rowid, x) values (?, ?)", [(ord(c), "q" + c) for c in letters])
    want = {doc: term for term, doc in con.execute("select term, doc from v where offset = 0")}
    rows = spark.createDataFrame([(ord(c), "q" + c) for c in letters], "id int, text string")
    got = dict(rows.select("id", fold("text")).collect())
    assert {i: got[i] for i in want} == want


def _porter(words):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='porter')")
    con.execute("create virtual table v using fts5vocab(t, 'instance')")
    con.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(words)))
    return {words[doc]: term for term, doc in con.execute("select term, doc from v where offset = 0")}


def test_stems_of_built_words():
    stems = ["relat", "condit", "hop", "hopp", "fall", "fil", "agre", "bl", "plaster", "motor",
             "siz", "happ", "sk", "y", "sy", "by", "vietnam", "oper", "feud", "a", "ab", "tr",
             "controll", "roll", "probat", "rat", "ceas", "adopt", "élection", "ss", "iz", "oy"]
    ends = ["", "s", "es", "ies", "sses", "ed", "eed", "ing", "y", "ational", "tional", "enci",
            "anci", "izer", "bli", "alli", "entli", "eli", "ousli", "ization", "ation", "ator",
            "alism", "iveness", "fulness", "ousness", "aliti", "iviti", "biliti", "logi", "icate",
            "ative", "alize", "iciti", "ical", "ful", "ness", "al", "ance", "ence", "er", "ic",
            "able", "ible", "ant", "ement", "ment", "ent", "ion", "sion", "tion", "ou", "ism",
            "ate", "iti", "ous", "ive", "ize", "e", "ll", "lle", "zzed", "tting", "x", "w"]
    words = sorted({a + b for a in stems for b in ends} | {"x" * 64 + "s", "x" * 63 + "s", "is"})
    want = _porter(words)
    folded = {w: stem_word(w.replace("é", "e")) for w in words}
    assert {w: folded[w] for w in want} == want


def test_stems_of_corpus(documents):
    words = [r[0] for r in documents.select(F.explode(tokenize("text"))).distinct().collect()]
    want = _porter(words)
    assert {w: stem_word(w) for w in words} == {w: want[w] for w in words}


def test_stem_column_keeps_shape(spark):
    rows = spark.createDataFrame([(1, ["running", "cats"]), (2, []), (3, None), (4, ["x"])],
                                 "id int, t array<string>")
    got = dict(rows.select("id", stem_tokens("t")).collect())
    assert got[1] == ["run", "cat"] and got[2] == [] and got[4] == ["x"]
    assert not got[3]
