"""Registered queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import (
    bitpack, bpe, hamming, licenses, linetemplates, mixing, neardup, negatives, preferences, quality, runs, secrets,
    toxicity,
)
from textloom.llm.columns import as_text, words_of
from textloom.plans.workdir import materialize

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TOP_K = 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with the last answer of the next one.

    The rejected side is what a model might have said instead: turns before the last
    answer are common, that answer comes from the conversation with the next id, and
    what followed it is gone.
    """
    turns = _table(spark, sf_dir, "conversations")
    last = (turns.where("role = 'assistant'").groupBy("conv_id")
            .agg(F.max(F.struct("turn", "text")).alias("last")))
    other = last.select((F.col("conv_id") - 1).alias("pair_id"), F.col("last")["text"].alias("text"))
    split = last.select(F.col("conv_id").alias("pair_id"), F.col("last")["turn"].alias("at"))
    chosen = turns.withColumnRenamed("conv_id", "pair_id")
    before = chosen.join(split, "pair_id").where("turn < at").select("pair_id", "turn", "role", "text")
    answer = split.join(other, "pair_id").select("pair_id", F.col("at").alias("turn"),
                                                 F.lit("assistant").alias("role"), "text")
    formatted = preferences.format_preferences(chosen, before.unionByName(answer))
    return formatted.select("pair_id", "part", "prompt", "chosen", "rejected", *[
        F.array_join(F.transform(p, lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias(p)
        for p in ("chosen_spans", "rejected_spans")])


_OP1 = r"""with last as (
        select conv_id, max(turn) as at, arg_max(text, turn) as text from conversations
        where role = 'assistant' group by conv_id),
    c as (select conv_id as pair_id, turn, role, text from conversations),
    r as (select c.pair_id, c.turn, c.role, c.text from c join last on c.pair_id = last.conv_id where c.turn < last.at
          union all
          select a.conv_id, a.at, 'assistant', b.text from last a join last b on b.conv_id = a.conv_id + 1),
    t as (select pair_id, turn, role, text, bool_or(side = 1) as in_c, bool_or(side = 2) as in_r from
          (select *, 1 as side from c union all select *, 2 from r) group by all),
    s as (select pair_id, min(turn) as split from t where in_c <> in_r group by pair_id),
    p as (select t.*, s.split is null or turn < s.split as is_prompt from t left join s using (pair_id)),
    parts as (select pair_id, 'prompt' as part, turn, role, text from p where is_prompt
              union all select pair_id, 'chosen', turn, role, text from p where not is_prompt and in_c
              union all select pair_id, 'rejected', turn, role, text from p where not is_prompt and in_r),
    shown as (select *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as rendered from parts),
    placed as (select *, sum(length(rendered)) over (partition by pair_id, part order by turn, role, text)
                   - length(rendered) + 13 + length(role) as start from shown),
    whole as (select pair_id, part, string_agg(rendered, '' order by turn, role, text) as text,
        string_agg(case when role = 'assistant' then cast(start as bigint) || ':' || cast(start + length(text) + 10 as bigint) end,
                   ',' order by turn, role, text) as spans from placed group by pair_id, part)
    select pair_id, cast(0 as bigint) as part,
        coalesce(max(case when part = 'prompt' then text end), '') as prompt,
        coalesce(max(case when part = 'chosen' then text end), '') as chosen,
        coalesce(max(case when part = 'rejected' then text end), '') as rejected,
        coalesce(max(case when part = 'chosen' then spans end), '') as chosen_spans,
        coalesce(max(case when part = 'rejected' then spans end), '') as rejected_spans
    from whole group by pair_id"""


def op2_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every embedding whose id is divisible by 50."""
    codes = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"),
                                                       hamming.sign_code("embedding").alias("code"))
    return hamming.nearest_codes(codes, codes.where(F.col("id") % 50 == 0), TOP_K)


_OP2 = """with c as (select vec_id as id, list_transform(embedding, lambda x: x > 0) as code from embeddings),
    q as (select id as query_id, code as q from c where id % 50 = 0),
    d as (select query_id, id, len(list_filter(range(1, 65), lambda i: q[i] <> code[i])) as distance from q, c),
    r as (select *, row_number() over (partition by query_id order by distance, id) as rank from d)
    select query_id, rank, id, distance from r where rank <= 10"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    mix = mixing.mixed(docs, mixing.plan_mix(docs))
    return mix.select("row.doc_id", "size", "source_size", "target",
                      (F.col("size") * F.col("repetitions")).alias("taken"), "repetitions")


_OP3 = r"""with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
        substr(md5('17:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 3) as bucket
        from documents),
    s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
    w as (select *, cast([5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as double) as weight,
        from s),
    c as (select *, 2.0 * source_size as cap, 2.0 * source_size / weight as ratio from w where source_size > 0),
    l as (select *, ((select 1.5 * sum(source_size) from w)
            - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as level
          from c),
    f as (select arg_min(level, ratio) as level from l where level <= ratio),
    t as (select source, source_size, least(cap, coalesce(weight * f.level, cap)) as target from c, f
          union all select source, source_size, 0.0 from w where source_size = 0),
    p as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from t),
    b as (select source, bucket, sum(size) as size from d group by all),
    r as (select *, coalesce(sum(size) over (partition by source order by bucket
            rows between unbounded preceding and 1 preceding), 0) as before from b),
    cuts as (select r.source, max(bucket) as cut from r join p on r.source is not distinct from p.source
             where before + size / 2.0 < target - whole * source_size group by r.source),
    plan as (select p.*, cut from p left join cuts on p.source is not distinct from cuts.source),
    m as (select doc_id, size, source_size, target, cast(case when size > 0 then whole
            + case when bucket <= cut then 1 else 0 end else 0 end as bigint) as repetitions
          from d join plan on d.source is not distinct from plan.source)
    select doc_id, size, source_size, target, size * repetitions as taken, repetitions from m"""


def _figures(docs: DataFrame) -> DataFrame:
    return materialize(quality.with_verdict_inputs(
        quality.base_figures(docs, keep=["doc_id", "lang", "source"])), "quality-figures")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = _figures(_table(spark, sf_dir, "documents"))
    return quality.judged(figures, quality.thresholds(figures)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sketch(f: str) -> str:
    return f"""select lang, source, '{f}' as figure, case when {f} > 0
        then cast(floor(ln({f}) * {quality.STEPS}) as int) else -1000000 end as bucket, count(*) as n
        from v where not base_failed group by all"""


def _ends(by: str) -> str:
    """Rows of a group and both ends of the middle eight tenths of each figure, as edges of buckets."""
    ends = "".join(f""",
        min(bucket) filter (figure = '{f}' and 10 * up_to >= {tenths} * total) as {f}_{end}"""
                   for f in quality.FIGURES for end, tenths in (("low", 1), ("high", 9)))
    edges = "".join(f""",
        case when {f}_{end} > -1000000 then exp(({f}_{end} + {up}) / {quality.STEPS}.0) else 0 end as {f}_{end}"""
                    for f in quality.FIGURES for end, up in (("low", 0), ("high", 1)))
    return f"""select {by} total {edges} from (select {by} max(total) as total {ends} from (
        select {by} figure, bucket, sum(n) over (partition by {by} figure) as total,
            sum(n) over (partition by {by} figure order by bucket) as up_to
        from (select {by} figure, bucket, sum(n) as n from f group by all)) group by all)"""


_Q4 = "".join(f""",
    case when gg.total >= 30 then gg.{f}_{e} when ll.total >= 30 then ll.{f}_{e} else tt.{f}_{e} end as {f}_{e}"""
              for f in quality.FIGURES for e in ("low", "high"))
_INSIDE = "".join(f"""
        and {f} between {f}_low - 2.0 * ({f}_high - {f}_low) - case when {n} > 0 then 4.0 / {n} else 0 end
            and {f}_high + 2.0 * ({f}_high - {f}_low) + case when {n} > 0 then 4.0 / {n} else 0 end"""
                  for f, n in quality.FIGURES.items())


_OP4 = rf"""with w as (select doc_id, lang, source, coalesce(text, '') as text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
    x as (select *, list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) as lines from w),
    n as (select row_number() over () as k, doc_id, lang, source, len(words) as n_words,
        coalesce(list_sum(list_transform(words, lambda y: length(y))), 0) as word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
        len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, words from x),
    g as (select k, unnest(range(1, n_words - 1)) as i, words from n where n_words >= 3),
    g3 as (select k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as three from g),
    rep as (select k, i from (select k, i, count(*) over (partition by k, three) as c from g3) where c > 1),
    hit as (select k, count(distinct i + o) as n_repeat_words from rep, (values (0), (1), (2)) as o(o) group by k),
    u as (select n.* exclude (words), coalesce(n_repeat_words, 0) as n_repeat_words from n left join hit using (k)),
    v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
        case when n_words > 0 then n_symbols / n_words else 0 end as symbol_share,
        case when n_words > 0 then word_chars / n_words else 0 end as word_length,
        case when n_lines > 0 then n_dup_lines / n_lines else 0 end as dup_line_share from u),
    f as ({" union all ".join(_sketch(f) for f in quality.FIGURES)}),
    gg as ({_ends('lang, source,')}), ll as ({_ends('lang,')}), tt as ({_ends('')}),
    b as (select gg.lang, gg.source {_Q4} from gg join ll on gg.lang is not distinct from ll.lang, tt)
    select doc_id, n_words, cast(word_chars as bigint) as word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        coalesce(not base_failed {_INSIDE}, false) as kept
    from v left join b on v.lang is not distinct from b.lang and v.source is not distinct from b.source"""


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                        F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score",
                        F.to_json("spans").alias("spans"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(_table(spark, sf_dir, "documents"), VOCABULARY))


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linetemplates.dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_dropped", "kept_text")


_OP7 = r"""with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text,
        coalesce(doc_id, 9223372036854775807) as doc from documents),
    s as (select k, doc, string_split(text, chr(10)) as lines from d),
    l as (select k, doc, pos, list_transform(regexp_extract_all(lines[pos], '[^\x20\x09-\x0D]+'),
            lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end) as tokens
          from (select *, unnest(range(1, len(lines) + 1)) as pos from s)),
    w as (select *, len(tokens) as n, tokens[1:3] as head from l where len(tokens) > 0),
    q as (select n, head, tokens, count(distinct doc) as docs from w group by all),
    busy as (select n, head from q group by all having sum(docs) >= 10),
    q2 as (select q.* from q join busy using (n, head)),
    p as (select n, head, tokens, unnest(range(1, n + 1)) as place, unnest(tokens) as token from q2),
    f as (select n, head, place, token from p group by all having count(*) >= 3),
    wide as (select n, head, tokens, list((place, token) order by place) as fixed from p join f using (n, head, place, token)
        where token <> '<*>' group by all having count(*) >= 0.7 * n),
    own as (select q2.n, q2.head, q2.tokens, fixed from q2 left join wide using (n, head, tokens)),
    t as (select n, head, tokens, fixed, case when fixed is null then tokens end as alone from own),
    m as (select w.n, w.head, fixed, alone, count(distinct doc) as n_docs, min(doc) as first_doc
          from w join t using (n, head, tokens) group by all having count(distinct doc) >= 10),
    gone as (select distinct w.k, w.pos from w join t using (n, head, tokens)
        join m on m.n = w.n and m.head = w.head and m.fixed is not distinct from t.fixed
            and m.alone is not distinct from t.alone where w.doc <> m.first_doc),
    x as (select k, list(pos) as gone from gone group by k)
    select d.doc_id, cast(len(lines) as bigint) as n_lines, cast(coalesce(len(gone), 0) as bigint) as n_dropped,
        coalesce(array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: not list_contains(coalesce(gone, []), i)),
            lambda i: lines[i]), chr(10)), '') as kept_text
    from d join s using (k) left join x using (k)"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"),
                         F.to_json("offending").alias("offending"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


_OP9 = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as t from documents),
    s as (select distinct doc_id, array_to_string(t[i:i + 4], ' ') as g
          from (select doc_id, t, unnest(range(1, greatest(len(t) - 3, 2))) as i from w where len(t) > 0)),
    n as (select doc_id, count(*) as n from s group by doc_id),
    p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b using (g) where a.doc_id <> b.doc_id group by all),
    e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)),
    r as (select doc_id as node, doc_id as reached from documents
          union select r.node, e.b from r join e on e.a = r.reached),
    c as (select node, min(reached) as component_id from r group by node)
    select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
    from documents d left join n using (doc_id) join c on c.node = d.doc_id"""


def op10_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = bitpack.write_documents(spark, _table(spark, sf_dir, "documents"), VOCABULARY, end_id=1)
    return bitpack.with_crc(bitpack.read_shards(manifest))


def _spans(spans) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "literal")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(_spans(base), 256).alias("base_sha256"), _spans("spans").alias("spans"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.integer_rows(_table(spark, sf_dir, "embeddings"), label=label)
    return negatives.mine_negatives(rows, F.col("id") % 50 == 0)


_OP12 = """with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
        where vec_id is not null and label is not null and embedding is not null
          and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id as id,
        cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) as bigint) as score
        from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
    p as (select anchor_id, id as positive_id, score as positive_score from s where same
        qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
    n as (select p.*, s.id as negative_id, s.score as negative_score,
        row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id) as rank
        from p join s on s.anchor_id = p.anchor_id and not s.same
        where 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
    select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score
    from n where rank <= 3"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one document in ten has its words repeated from some place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    # A stored array column: the words are made once and read several times.
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words_of(as_text("text"))).alias("w"))
    n, g = F.size("w"), F.col("g")
    rows = rows.select("*", n.alias("n"), F.when(n > 0, g % n).cast("int").alias("a"))
    rows = rows.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int").alias("p"))
    tail = F.slice("w", F.col("a") + 1, "p")
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(tail, times)), F.lit(1), F.col("n") - F.col("a"))
    changed = F.array_join(F.concat(F.slice("w", F.lit(1), "a"), again), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_planted_runs(_table(spark, sf_dir, "documents")))
    # Runs come by start and period: of equal exponents the first one stays.
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(
        r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_preferences, op2_hamming_topk, op3_mixing, op4_quality, op5_licenses, op6_bpe, op7_line_templates,
        op8_toxicity, op9_near_duplicates, op10_packed_ids, op11_secrets, op12_hard_negatives, op13_periodic_runs,
        pipeline)}

SQL = {"op1_preferences": _OP1, "op2_hamming_topk": _OP2, "op3_mixing": _OP3, "op4_quality": _OP4, "op7_line_templates": _OP7,
       "op9_near_duplicates": _OP9, "op12_hard_negatives": _OP12}
