"""Queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genoframe.functions.names import contig_key
from genoframe.llm.format_duplicates import bare, count_copies, pairs_as_set, runs_as_set
from genoframe.llm.leaks import leaked_items
from genoframe.llm.packing import pack_texts, token_counts
from genoframe.llm.percentiles import checked_ranks, merge_summaries, percentiles, summarise, values_of
from genoframe.llm.truncation import prefix_texts, truncated_texts
from genoframe.operators.joins import join_null_safe
from genoframe.tables import read_table

#: Percentiles and metrics of problem 5.
POINTS, METRICS = [1, 25, 50, 75, 95, 99], ["vcf_qual", "call_depth", "alt_freq"]


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "site_submissions")
    # The position's digits come last first, so that few leading bytes spread all records.
    canon = F.concat_ws(
        "|", F.reverse(bare(F.col("vcf_pos"))), contig_key(bare(F.col("vcf_chrom"))), bare(F.col("vcf_ref")), runs_as_set(F.col("vcf_alt")), pairs_as_set(F.col("vcf_info"))
    )
    return count_copies(rows.select("sub_id", canon.alias("canon")), "sub_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group of equal records: its smallest sub_id with every other member."""
    return _copies(spark, sf_dir).filter("sub_id <> rep").select(F.col("rep").alias("sub_id"), F.col("sub_id").alias("dup_sub_id"))


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record, under its smallest sub_id, with the number of its copies."""
    return _copies(spark, sf_dir).filter("sub_id = rep").select("sub_id", F.col("n").alias("n_copies"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "call_metrics").select("metric_id", "panel_id", "called_on", *METRICS).dropDuplicates()


def _day_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise(_metrics(spark, sf_dir), ["panel_id", "called_on"], METRICS)


def p5_panel_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per panel, from the merged summaries of its days."""
    return percentiles(merge_summaries(_day_summaries(spark, sf_dir), ["panel_id", "metric"]), ["panel_id", "metric"], POINTS)


def p5_day_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per panel and day."""
    return percentiles(_day_summaries(spark, sf_dir), ["panel_id", "called_on", "metric"], POINTS)


def p5_panel_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each percentile of a panel has a rank within its stated error."""
    values = values_of(_metrics(spark, sf_dir), ["panel_id"], METRICS)
    return checked_ranks(values, p5_panel_percentiles(spark, sf_dir), ["panel_id", "metric"])


def p5_day_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per panel and day."""
    values = values_of(_metrics(spark, sf_dir), ["panel_id", "called_on"], METRICS)
    return checked_ranks(values, p5_day_percentiles(spark, sf_dir), ["panel_id", "called_on", "metric"])


def p5_panel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values the merged summaries of each panel stand for."""
    return merge_summaries(_day_summaries(spark, sf_dir), ["panel_id", "metric"]).select("panel_id", "metric", F.col("n").alias("n_values"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = token_counts(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return pack_texts(sizes, "doc_id", read_table(spark, sf_dir, "pack_specs"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container, place and step group of every text, for each capacity."""
    return _packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: texts, pieces, containers, and the share of their space that is used."""
    each = _packed(spark, sf_dir).groupBy("spec_id", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("pieces"))
    return each.groupBy("spec_id", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("pieces").alias("n_pieces"),
        F.sum("used").alias("n_tokens"),
        (F.sum("used") / (F.count(F.lit(1)) * F.first("capacity_tokens"))).alias("fill"),
    )


def p7_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each text and capacity, whether its pieces follow one another without a gap, whether
    it is divided only if it exceeds the capacity, and whether its containers hold no more than
    they may."""
    load = F.sum("n_tokens").over(W.partitionBy("spec_id", "container_id"))
    rows = _packed(spark, sf_dir).withColumn("_load", load)
    follows = (F.min("piece_no") == 1) & (F.max("piece_no") == F.count(F.lit(1))) & (F.sum("first_token") == F.first("capacity_tokens") * (F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2))
    return rows.groupBy("spec_id", "doc_id").agg(
        follows.alias("follows"),
        ((F.count(F.lit(1)) == 1) | (F.sum("n_tokens") > F.first("capacity_tokens"))).alias("divided_only_if_long"),
        F.bool_and(F.col("_load") <= F.col("capacity_tokens")).alias("fits"),
    )


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with windows up to two word edits from an item's, and how near."""
    return leaked_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share thirteen words in a row with an item, and the item."""
    return p8_near(spark, sf_dir).filter("edits = 0").select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items leaked, and into how many documents and sources."""
    hits = p8_found(spark, sf_dir).join(read_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.count_distinct("source").alias("n_sources"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text ends before their file did."""
    return truncated_texts(read_table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p9_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text is a strict prefix of a longer one, and how that one goes on."""
    kinds = F.array(F.lit("blanks"), F.lit("line_end"), F.lit("mid_line"))
    return prefix_texts(read_table(spark, sf_dir, "documents")).select("doc_id", F.get(kinds, F.col("kind")).alias("goes_on"))


def p9_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents with text, cut ones by each way of finding them, and their share."""
    docs = read_table(spark, sf_dir, "documents").filter("text is not null")
    one = F.count(F.lit(1))
    cut = truncated_texts(docs).groupBy("source").agg(one.alias("n_cut"), F.count_if(F.col("found_by") == "prefix").alias("n_prefix"))
    rows = docs.groupBy("source").agg(one.alias("n_docs"))
    counts = [F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in ("n_cut", "n_prefix")]
    return join_null_safe(rows, cut, ["source"], "left").select("source", "n_docs", *counts).withColumn("cut_share", F.col("n_cut") / F.col("n_docs"))


QUERIES = {
    "p4_found": p4_found,
    "p4_records": p4_records,
    "p5_panel_percentiles": p5_panel_percentiles,
    "p5_day_percentiles": p5_day_percentiles,
    "p5_panel_counts": p5_panel_counts,
    "p5_panel_checked": p5_panel_checked,
    "p5_day_checked": p5_day_checked,
    "p7_packed": p7_packed,
    "p7_fill": p7_fill,
    "p7_placed": p7_placed,
    "p8_found": p8_found,
    "p8_items": p8_items,
    "p8_near": p8_near,
    "p9_found": p9_found,
    "p9_prefixes": p9_prefixes,
    "p9_sources": p9_sources,
}

_P4 = r"""
with marked as (
  select sub_id, regexp_replace(lower(coalesce(vcf_pos, '')), '[^\p{L}\p{N}]+', '', 'g') as pos,
    regexp_replace(regexp_replace(lower(coalesce(vcf_chrom, '')), '[^\p{L}\p{N}]+', '', 'g'), '^chr', '') as chrom,
    regexp_replace(lower(coalesce(vcf_ref, '')), '[^\p{L}\p{N}]+', '', 'g') as ref,
    list_sort(list_distinct(regexp_extract_all(lower(coalesce(vcf_alt, '')), '[\p{L}\p{N}]+'))) as alts,
    string_split(regexp_replace(lower(coalesce(vcf_info, '')), '([\p{L}\p{N}]+)["''\s]*[=:]', chr(1) || '\1=', 'g'), chr(1)) as parts
  from site_submissions),
canon as (
  select sub_id, pos, chrom, ref, alts, list_sort(list_distinct(list_filter(list_transform(parts,
    lambda p: regexp_extract(p, '^([\p{L}\p{N}]+=)', 1) || list_aggregate(list_concat([''], regexp_extract_all(regexp_replace(p, '^[\p{L}\p{N}]+=', ''), '[\p{L}\p{N}]+')), 'string_agg', '.')),
    lambda p: p <> ''))) as pairs from marked),
counted as (select sub_id, min(sub_id) over w as rep, count(*) over w as n from canon window w as (partition by pos, chrom, ref, alts, pairs))
"""

_P8 = """
with doc as (select doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') as w from documents where text is not null),
item as (select item_id, regexp_extract_all(passage, '[A-Za-z0-9]+') as w from eval_items where passage is not null),
hits as (
  select distinct d.doc_id, i.item_id from
    (select doc_id, lower(array_to_string(w[k:k + 12], ' ')) as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as k from doc where len(w) >= 13)) d
    join (select distinct item_id, lower(array_to_string(w[k:k + 12], ' ')) as g from (select item_id, w, unnest(range(1, len(w) - 11)) as k from item where len(w) >= 13)) i
    on d.g = i.g)
"""

_P5 = """
with once as (select distinct metric_id, panel_id, called_on, vcf_qual, call_depth, alt_freq from call_metrics),
long as (
  select panel_id, called_on, 'vcf_qual' as metric, vcf_qual as x from once union all select panel_id, called_on, 'call_depth', call_depth::double from once
  union all select panel_id, called_on, 'alt_freq', alt_freq from once),
panels as (select panel_id, metric, count(*) as n_values from long where x >= 0 and not isnan(x) group by all),
days as (select panel_id, called_on, metric, count(*) as n_values from long where x >= 0 and not isnan(x) group by all)
"""

_P9 = r"""
with solid as (select doc_id, text, length(text) as n from documents where regexp_matches(text, '[^ \t\r\n\f]')),
pairs as (
  select a.doc_id, case when not regexp_matches(substr(b.text, a.n + 1), '[^ \t\r\n\f]') then 0
      when right(a.text, 1) in (chr(10), chr(13)) or substr(b.text, a.n + 1, 1) in (chr(10), chr(13)) then 1 else 2 end as kind
  from solid a join solid b on left(a.text, 1) = left(b.text, 1) and b.n > a.n and starts_with(b.text, a.text))
select doc_id, (['blanks', 'line_end', 'mid_line'])[max(kind) + 1] as goes_on from pairs group by doc_id"""

ORACLE = {
    "p5_panel_counts": _P5 + "select * from panels",
    "p5_panel_checked": _P5 + "select *, unnest([1, 25, 50, 75, 95, 99])::int as pct, true as within from panels",
    "p5_day_checked": _P5 + "select *, unnest([1, 25, 50, 75, 95, 99])::int as pct, true as within from days",
    "p4_found": _P4 + "select rep as sub_id, sub_id as dup_sub_id from counted where sub_id <> rep",
    "p4_records": _P4 + "select sub_id, n as n_copies from counted where sub_id = rep",
    "p8_found": _P8 + "select doc_id, item_id from hits",
    "p7_placed": "select spec_id, doc_id, true as follows, true as divided_only_if_long, true as fits from documents, pack_specs",
    "p9_prefixes": _P9,
    "p8_items": _P8 + "select item_id, count(*) as n_docs, count(distinct source) as n_sources from hits join documents using (doc_id) group by 1",
}
