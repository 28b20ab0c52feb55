"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figmill.functions.keys import article_digits, hash_key, instant, panel_stem, path_key, without_extension
from figmill.llm.groups import connected_groups
from figmill.llm.history import dedup_deliveries
from figmill.llm.bpe import encode_corpus
from figmill.llm.leaks import leaks
from figmill.llm.lookalikes import form_sql, same_to_the_eye
from figmill.llm.markup import markup_to_text
from figmill.llm.neighbours import similar_vectors
from figmill.llm.topn import top_n
from figmill.plans.core_queries import _INSTANT, _path_sql
from figmill.sources.tables import table


def _key(kind: str, *parts):
    """A struct of kind and signature; the signature is NULL where a part is."""
    text = F.concat(*[x for p in parts for x in (p, F.lit("|"))])
    return F.struct(F.lit(kind).alias("kind"), F.sha2(text, 256).alias("sig"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return markup_to_text(table(spark, d, "figures")).where(F.size("kinds") > 0).select("row_no")


def p1_text(spark: SparkSession, d: str) -> DataFrame:
    return markup_to_text(table(spark, d, "figures")).withColumn("kinds", F.array_join("kinds", ","))


def _deliveries(rows: DataFrame):
    """The delivery of a row: its batch, each checked against the history on its own.

    A batch begins at the first row of its own or a later number, so that rows keep
    their order even where numbers do not: a row belongs to the greatest number up
    to it, rows before any number to the first.  One line per batch reaches the driver.
    """
    begins = rows.where("batch_no is not null").groupBy("batch_no").agg(F.min("row_no").alias("at")).orderBy(F.col("batch_no").desc()).collect()
    at, cuts = None, []
    for r in begins:
        if at is None or r["at"] < at:
            at = r["at"]
            cuts.append((at, r["batch_no"]))
    if not cuts:
        return F.lit(0)
    starts, numbers = zip(*reversed(cuts), strict=True)
    return F.element_at(F.lit(list(numbers)), F.greatest(F.size(F.filter(F.lit(list(starts)), lambda x: x <= F.col("row_no"))), F.lit(1)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    f, a = table(spark, d, "figures"), table(spark, d, "articles")
    path = without_extension(path_key(F.col("file_path"), F.col("pmcid")))
    keys = F.array(F.struct(F.lit("file").alias("kind"), hash_key(F.col("sha256")).alias("sig")), _key("path", article_digits(F.col("pmcid")), path))
    version = F.array(_key("version", article_digits(F.col("pmcid")), F.unix_micros(instant(F.col("updated_at"))).cast("string")))
    # both tables go through one history: their kinds of key differ, and so does the last bit of their row
    number = F.col("row_no").cast("bigint") * 2
    rows = f.select(number.alias("row"), keys.alias("keys"), _deliveries(f).alias("delivery")).unionByName(a.select((number + 1).alias("row"), version.alias("keys"), _deliveries(a).alias("delivery")))
    src = F.when(F.col("dup_row") % 2 == 0, "figures").otherwise("articles")
    return dedup_deliveries(rows).select(src.alias("src"), F.expr("kept_row div 2").alias("kept_row"), F.expr("dup_row div 2").alias("dup_row"))


def matched_pairs(pair_matches: DataFrame, detections: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of full panel uids whose latest judged run is a match."""
    p = pair_matches.where("is_match is not null").select(panel_stem(F.col("panel_a")).alias("x"), panel_stem(F.col("panel_b")).alias("y"), "is_match", "run_at")
    p = p.where("x is not null and y is not null and x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "is_match", "run_at")
    p = p.groupBy("x", "y").agg(F.max(F.struct("run_at", "is_match")).alias("s")).where("s.is_match").select("x", "y")
    full = detections.select(panel_stem(F.col("panel_uid")).alias("stem"), F.trim("panel_uid").alias("uid")).where("stem is not null").groupBy("stem").agg(F.min("uid").alias("uid"))
    for side in ("x", "y"):
        p = p.join(full.withColumnRenamed("stem", side).withColumnRenamed("uid", f"u{side}"), side, "left")
    return p.select(F.coalesce("ux", "x").alias("a"), F.coalesce("uy", "y").alias("b"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    groups = connected_groups(matched_pairs(table(spark, d, "pair_matches"), table(spark, d, "detections")))
    return groups.select(F.col("group").alias("group_uid"), F.col("member").alias("panel_uid"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_vectors(table(spark, d, "cbir_index"), 5).select("item_id", F.col("match").alias("match_id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    det = top_n(table(spark, d, "detections"), ["figure_id", "class_id"], "conf", "row_no", 3, once=["panel_uid"])
    m = table(spark, d, "cbir_matches").where("path <> query_path")
    m = top_n(m.withColumn("score", F.when(F.col("score") != -1, F.col("score"))), ["query_path"], "score", "row_no", 5, once=["path"])
    return det.select(F.lit("detections").alias("src"), "row_no").unionByName(m.select(F.lit("cbir_matches").alias("src"), "row_no"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), paraphrases=False).select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return same_to_the_eye(table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p1_text": p1_text, "p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p8_ids": p8_ids, "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found}

def _words_sql(column: str) -> str:
    """Words of a text in their comparable form; Unicode escapes of JSON records are read."""
    piece = "case when i = 1 then x when regexp_matches(x, '^[0-9a-fA-F]{4}') then case when regexp_matches(x, '^[dD][89a-fA-F]') then ' ' else chr(('0x' || x[1:4])::int) end || x[5:] else '\\u' || x end"
    plain = f"array_to_string(list_transform(string_split({column}, '\\u'), lambda x, i: {piece}), '')"
    return f"regexp_extract_all(lower({form_sql(plain)}), '[\\p{{L}}\\p{{N}}]+')"


ORACLE = {
    # the form by the table; tokens whose letters have two shapes are the automaton's alone
    "p10_found": f"""with f as (select doc_id, text, {form_sql('text')} as form from documents where text <> '')
      select least(a.doc_id, b.doc_id) as doc_a, greatest(a.doc_id, b.doc_id) as doc_b from f a join f b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text""",
    "p9_found": f"""with d as (select doc_id, {_words_sql('text')} as w from documents where text is not null), i as (select item_id, {_words_sql('text')} as w from eval_items where text is not null),
      dw as (select doc_id, array_to_string(w[k:k + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d)), iw as (select item_id, array_to_string(w[k:k + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as k from i))
      select distinct doc_id, item_id from dw join iw using (g)""",
    # row by row: the list of keys taken so far decides each row
    "p2_found": rf"""with recursive f as (select row_no, nullif(regexp_replace(pmcid, '[^0-9]', '', 'g'), '') as a, {_path_sql('file_path')} as p,
    lower(regexp_extract(sha256, '[0-9A-Fa-f]{{64}}')) as h from figures),
  k as (select row_no, list_filter([case when h <> '' and h <> repeat('0', 64) then hash('file', h) end, case when a is not null and p is not null then hash('path', a, regexp_replace(p, '([^/])\.[^./]+$', '\1')) end], lambda x: x is not null) as ks from f),
  v as (select row_no, list_filter([case when updated_at is not null and nullif(regexp_replace(pmcid, '[^0-9]', '', 'g'), '') is not null then hash('version', regexp_replace(pmcid, '[^0-9]', '', 'g'), {_INSTANT}) end], lambda x: x is not null) as ks from articles),
  s as (select 'figures' as src, row_no, ks, row_number() over (order by row_no) as n from k union all select 'articles', row_no, ks, row_number() over (order by row_no) from v),
  r as (select src, 0::bigint as n, []::ubigint[] as taken, false as ok from (values ('figures'), ('articles')) t(src)
    union all select s.src, s.n, case when list_has_any(r.taken, s.ks) then r.taken else list_concat(r.taken, s.ks) end, not list_has_any(r.taken, s.ks) from r join s on s.src = r.src and s.n = r.n + 1),
  kept as (select s.src, s.row_no, unnest(s.ks) as x from r join s using (src, n) where r.ok), every as (select src, row_no, unnest(ks) as x from s)
  select distinct kept.src, kept.row_no as kept_row, every.row_no as dup_row from kept join every using (src, x) where kept.row_no < every.row_no""",
    "p4_found": """with recursive s as (
        select regexp_replace(trim(panel_a), '::cls=[^:]*$', '') as x, regexp_replace(trim(panel_b), '::cls=[^:]*$', '') as y, is_match, run_at from pair_matches where is_match is not null),
      p as (select least(x, y) as x, greatest(x, y) as y, arg_max(is_match, run_at) as m from s where x <> y group by 1, 2),
      u as (select regexp_replace(trim(panel_uid), '::cls=[^:]*$', '') as stem, min(trim(panel_uid)) as uid from detections group by 1),
      e as (select coalesce(a.uid, x) as a, coalesce(b.uid, y) as b from p left join u a on a.stem = x left join u b on b.stem = y where m),
      d as (select a, b from e union select b, a from e),
      r as (select a as v, a as w from d union select r.v, d.b from r join d on d.a = r.w)
      select min(w) as group_uid, v as panel_uid from r group by v""",
    "p5_found": """with u as (select item_id, index_id, embedding::double[] as e from cbir_index where len(embedding) = 64 and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
      s as (select a.item_id, b.item_id as match_id, round(list_cosine_similarity(a.e, b.e), 12) as c from u a join u b on a.index_id is not distinct from b.index_id and a.item_id <> b.item_id)
      select item_id, match_id from s qualify row_number() over (partition by item_id order by c desc, match_id) <= 5""",
    "p6_found": """with d as (select figure_id, class_id, panel_uid, min(row_no) as row_no, arg_min(conf, row_no) as conf from detections group by 1, 2, 3),
      m as (select query_path, path, min(row_no) as row_no, arg_min(score, row_no) as score from cbir_matches where path <> query_path group by 1, 2)
      select 'detections' as src, row_no from d where conf is not null and not isnan(conf) qualify row_number() over (partition by figure_id, class_id order by conf desc, row_no) <= 3
      union all select 'cbir_matches', row_no from m where score is not null and not isnan(score) and score <> -1 qualify row_number() over (partition by query_path order by score desc, row_no) <= 5""",
}
