"""Line dedup by a log-template tree of fixed depth, native columns only.

A line's leaf is its number of tokens and its leading tokens. Tokens with a digit are
variable fields from the start. Within a leaf, a token that few different lines have at
its place is variable too; a line takes that wider template if enough of its tokens stay
fixed, and else is its own template. A template that occurs in ``min_docs`` documents
or more is boilerplate: it stays in the first of them (smallest id) and goes elsewhere.

The first pass moves 64-bit hashes only, one for each distinct line of a document, summed
before the shuffle. Tokens are only looked at for lines whose leaf is in ``min_docs``
documents, once for each distinct line.

Defined cases: null texts are empty; lines without a word always stay and belong to no
template; repeats inside one document count once and stay or go together; rows with
equal ids are one document; null ids count as one document that comes last; an empty
table gives an empty result. Documents keep their other lines in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.columns import WORD, as_text, row_key
from textloom.plans.workdir import materialize

DEPTH = 3          # leading tokens in the tree
MIN_DOCS = 10      # documents that make a template boilerplate
FIXED_SHARE = 0.7  # tokens of a line that must stay fixed in its template
SUPPORT = 3        # different lines of a leaf that share a fixed token
VARIABLE = "<*>"
MARKS = 1 << 20    # numbers that tell rows which can lose a line from others; bounds what is broadcast


def masked_tokens(line: Column) -> Column:
    """The words of a line, those with a digit replaced."""
    return F.transform(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)),
                       lambda t: F.when(t.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(t))


def _leaf(tokens: Column, depth: int) -> Column:
    return F.xxhash64(F.size(tokens), F.slice(tokens, 1, depth))


def _lines(docs: DataFrame, depth: int, id_col: str, text_col: str) -> DataFrame:
    """(key, doc, position, line, seq, leaf) of every line with a word."""
    last = F.lit((1 << 63) - 1)
    lines = docs.select(row_key(id_col, text_col).alias("key"),
                        F.coalesce(F.col(id_col).cast("long"), last).alias("doc"),
                        F.posexplode(F.split(as_text(text_col), "\n", -1)).alias("position", "line"))
    lines = lines.where(F.col("line").rlike(WORD)).withColumn("tokens", masked_tokens(F.col("line")))
    return lines.select("key", "doc", "position", "line", F.xxhash64("tokens").alias("seq"),
                        _leaf(F.col("tokens"), depth).alias("leaf"))


def boilerplate(found: DataFrame, lines: DataFrame, min_docs: int, fixed_share: float,
                support: int) -> DataFrame:
    """(leaf, seq, template, n_docs, first_doc) of lines whose template is in ``min_docs`` documents.

    ``found`` is ``lines`` without the text, as written in a first pass.
    """
    each = found.groupBy("leaf", "seq", "doc").agg(F.lit(1).alias("one"))
    seqs = materialize(each.groupBy("leaf", "seq").agg(F.count(F.lit(1)).alias("docs"),
                                                       F.min("doc").alias("first")), "line-seqs")
    # Documents of a leaf, counted once for each of its lines: at least as many as it has.
    busy = seqs.groupBy("leaf").agg(F.sum("docs").alias("leaf_docs"), F.count(F.lit(1)).alias("n_seqs"))
    busy = materialize(busy.where(F.col("leaf_docs") >= min_docs), "line-leaves")
    # Leaves of a single line need no tokens.
    mixed_leaves = busy.where("n_seqs > 1").select("leaf")
    known = (lines.select("leaf", "seq", "line").join(mixed_leaves, "leaf", "left_semi")
             .groupBy("leaf", "seq").agg(F.min("line").alias("line")))
    known = materialize(known.select("leaf", "seq", masked_tokens(F.col("line")).alias("tokens")),
                        "line-tokens")
    places = known.select("leaf", "seq", F.posexplode("tokens").alias("place", "token"))
    fixed = (places.groupBy("leaf", "place", F.xxhash64("token").alias("token_hash"))
             .agg(F.count(F.lit(1)).alias("held")).where(F.col("held") >= support))
    # The template: hash and share of the places that stay fixed.
    p = places.withColumn("token_hash", F.xxhash64("token"))
    stays = p.where(F.col("token") != VARIABLE).join(fixed, ["leaf", "place", "token_hash"])
    wide = stays.groupBy("leaf", "seq").agg(
        F.sum(F.xxhash64("place", "token_hash").cast("decimal(38,0)")).alias("sum"),
        F.count(F.lit(1)).alias("n_fixed"))
    sizes = known.select("leaf", "seq", F.size("tokens").alias("n_tokens"))
    wide = (wide.join(sizes, ["leaf", "seq"]).where(F.col("n_fixed") >= fixed_share * F.col("n_tokens"))
            .select("leaf", "seq", F.xxhash64(F.col("sum").cast("string"), "n_fixed", "leaf").alias("template")))
    own = seqs.join(busy.select("leaf"), "leaf", "left_semi").join(wide, ["leaf", "seq"], "left")
    own = materialize(own.select("seq", "first", F.coalesce("template", "seq").alias("template"), "leaf"),
                      "line-templates")
    # A document may hold several lines of one template: count it once.
    members = each.join(own, ["leaf", "seq"]).groupBy("template", "doc").agg(F.lit(1).alias("one"))
    counts = members.groupBy("template").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc").alias("first_doc"))
    counts = counts.where(F.col("n_docs") >= min_docs)
    return materialize(own.join(counts, "template").select("leaf", "seq", "template", "n_docs", "first_doc"),
                       "line-boilerplate")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, fixed_share: float = FIXED_SHARE,
                support: int = SUPPORT, depth: int = DEPTH, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Every row as ``row``, with kept_text, n_lines (all \\n-split lines) and n_dropped."""
    lines = _lines(docs, depth, id_col, text_col)
    # What later passes need of a line, without its text.
    found = materialize(lines.drop("line"), "line-hashes")
    boiler = boilerplate(found, lines, min_docs, fixed_share, support)
    dropped = (found.join(boiler, ["leaf", "seq"]).where(F.col("doc") != F.col("first_doc"))
               .groupBy("key").agg(F.collect_set("position").alias("dropped")))
    dropped = materialize(dropped, "line-dropped").withColumnRenamed("key", "d_key")
    rows = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key"))
    # At most MARKS numbers tell which rows can lose a line; only those are joined and move.
    marks = F.broadcast(dropped.select(F.pmod("d_key", F.lit(MARKS)).alias("mark")).distinct())
    is_marked = F.pmod("key", F.lit(MARKS)) == F.col("mark")
    text = as_text(f"row.`{text_col}`")
    whole = rows.join(marks, is_marked, "left_anti").select(
        "row", text.alias("kept_text"), _n_lines(text).alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    # Texts are cut after the join, so that they move once. The join is the same at every size:
    # what is dropped grows with the table.
    cut = (rows.join(marks, is_marked, "left_semi").join(dropped.hint("merge"), F.col("key") == F.col("d_key"), "left")
           .select("row", "dropped", F.split(text, "\n", -1).alias("lines")))
    none = F.array().cast("array<int>")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("dropped", none))
    cut = cut.select("row", "lines", kept.alias("kept"))
    cut = cut.select("row", F.array_join(F.transform("kept", lambda i: F.get(F.col("lines"), i)), "\n")
                     .alias("kept_text"), F.size("lines").cast("long").alias("n_lines"),
                     (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"))
    return whole.unionByName(cut)


def _n_lines(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long")
