"""Queries p1, p2, p3 and p6: the general data problems over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genoframe.functions.names import contig_key, missing_as_null
from genoframe.operators.heavy_keys import key_summary
from genoframe.operators.packed_fields import ALLELES, ENTRIES, FORMATS, explode_packed
from genoframe.operators.parse_failures import parse_variant_lines
from genoframe.operators.table_diff import Field, table_diff
from genoframe.tables import read_table

#: Largest position a variant or alignment file can hold.
MAX_POS = 4_294_967_295


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that one copy of the site list lacks, and each field whose value differs."""
    fields = {
        "vcf_chrom": Field(contig_key(missing_as_null("vcf_chrom"))),
        "vcf_pos": Field(F.col("vcf_pos")),
        "vcf_ref": Field(F.upper(missing_as_null("vcf_ref"))),
        "vcf_alt": Field(F.upper(missing_as_null("vcf_alt"))),
        "vcf_qual": Field(F.col("vcf_qual"), tolerance=0.01),
        "vcf_filter": Field(missing_as_null("vcf_filter")),
        "vcf_info": Field(missing_as_null("vcf_info")),
    }
    sites, mirror = read_table(spark, sf_dir, "vcf_sites"), read_table(spark, sf_dir, "vcf_sites_mirror")
    return table_diff(sites, mirror, "rec_id", "loaded_at", fields, "missing_in_sites", "missing_in_mirror")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that don't parse, each with the first reason."""
    return parse_variant_lines(read_table(spark, sf_dir, "vcf_lines")).filter("reason is not null").select("line_id", "reason")


def p2_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid lines as typed variant rows."""
    return parse_variant_lines(read_table(spark, sf_dir, "vcf_lines")).filter("reason is null").drop("reason")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per value of the packed fields, with its place in the field."""
    fields = {"vcf_alt": ALLELES, "vcf_info": ENTRIES, "vcf_format": FORMATS}
    return explode_packed(read_table(spark, sf_dir, "vcf_calls"), "call_id", "bigint", fields)


def _contig_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        key_summary(read_table(spark, sf_dir, table), contig_key(chrom), pos, MAX_POS).withColumn("source_table", F.lit(table))
        for table, chrom, pos in (("alignments", "reference_name", "pos"), ("vcf_calls", "vcf_chrom", "vcf_pos"))
    ]
    contigs = read_table(spark, sf_dir, "contigs").select("contig_name", contig_key("contig_name").alias("_contig"))
    return parts[0].unionByName(parts[1]).join(contigs, F.col("key") == F.col("_contig"), "left")


def p6_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct records, range and median of positions of every contig, both tables.

    Rows on no contig of the dictionary (unplaced, null, unknown) keep their key and have
    no contig_name."""
    return _contig_summary(spark, sf_dir).select(
        "source_table",
        F.col("key").alias("contig_key"),
        "contig_name",
        F.col("rows").alias("n_rows"),
        F.col("distinct_records").alias("n_records"),
        F.col("first_value").alias("first_pos"),
        F.col("last_value").alias("last_pos"),
        F.col("median_value").alias("median_pos"),
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs to which at least one twentieth of a table's rows belong."""
    # A table has a row per contig by now, so its sum is over some hundred rows.
    total = F.sum("rows").over(W.partitionBy("source_table"))
    summary = _contig_summary(spark, sf_dir).withColumn("total", total)
    return summary.filter("contig_name is not null and rows * 20 >= total").select("source_table", "contig_name")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_variants": p2_variants, "p3_found": p3_found, "p6_found": p6_found, "p6_contigs": p6_contigs}

_SIDE = """
select rec_id, arg_max(r, (loaded_at, r)) as r from (
  select rec_id, loaded_at, struct_pack(
    c := regexp_replace(lower(trim(nullif(vcf_chrom, '.'))), '^chr', ''), p := vcf_pos, r := upper(nullif(vcf_ref, '.')),
    a := upper(nullif(vcf_alt, '.')), q := vcf_qual, f := nullif(vcf_filter, '.'), i := nullif(vcf_info, '.')) as r
  from {table}) group by rec_id"""

_P2 = r"""
with lines as (select line_id, file_name, line_no, regexp_replace(line_text, '\r$', '') as t from vcf_lines where line_text is not null),
heads as (select file_name, arg_min(length(t) - length(replace(t, chr(9), '')) + 1, (line_no, line_id)) as n from lines where starts_with(t, '#CHROM') group by 1),
marked as (
  select l.*, h.n, regexp_replace(regexp_replace(t, '([=,])"(?:[^"]|"")*"([;,\t]|$)', '\1Q\2', 'g'), '([=,])"(?:[^"]|"")*"([;,\t]|$)', '\1Q\2', 'g') as m
  from lines l left join heads h on l.file_name is not distinct from h.file_name
  where not starts_with(t, '#') and regexp_matches(t, '\S')),
cut as (select *, string_split(m, chr(9)) as c from marked),
named as (select *, c[2] as pos, c[4] as ref, c[5] as alt, c[6] as qual, regexp_replace(c[8], ';$', '') as info from cut),
counted as (
  select *, regexp_extract(';' || info || ';', ';AC(=?[^;]*);', 1) as ac, regexp_extract(';' || info || ';', ';AN(=?[^;]*);', 1) as an,
    regexp_matches(';' || info || ';', ';AC[=;]') as has_ac, regexp_matches(';' || info || ';', ';AN[=;]') as has_an from named),
judged as (
  select *, case
    when contains(m, '"') then 'quoting'
    when len(c) <> coalesce(n, greatest(len(c), 8)) then 'columns'
    when not regexp_full_match(pos, '0*[1-9][0-9]{0,9}') or try_cast(pos as decimal(38, 0)) not between 1 and 4294967295 then 'pos'
    when not regexp_full_match(ref, '[ACGTNacgtn]+') then 'ref'
    when not regexp_full_match(alt, '\.|([ACGTNacgtn]+|\*|<[A-Za-z0-9:_-]+>)(,([ACGTNacgtn]+|\*|<[A-Za-z0-9:_-]+>))*') then 'alt'
    when not regexp_full_match(qual, '\.|([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') then 'qual'
    when c[8] = '.' then null
    when not regexp_full_match(info, '[A-Za-z_][A-Za-z0-9_.]*(=[^;]*)?(;[A-Za-z_][A-Za-z0-9_.]*(=[^;]*)?)*') then 'info'
    when has_an and not regexp_full_match(an, '=[0-9]+') then 'info'
    when has_ac and not regexp_full_match(ac, '=[0-9]+(,[0-9]+)*') then 'info'
    when has_ac and len(string_split(ac, ',')) <> len(string_split(alt, ',')) then 'info'
    when has_ac and has_an and list_sum(list_transform(string_split(substr(ac, 2), ','), lambda x: cast(x as bigint))) > cast(substr(an, 2) as bigint) then 'info'
    end as reason
  from counted)
"""

# The text of INFO as it stands comes from quote-aware columns: quoted tabs are hidden first.
_P2_TYPED = (
    _P2
    + r"""
, hidden as (select line_id, file_name, line_no, string_split(list_aggregate(list_transform(string_split(t, '"'), lambda x, i: case when i % 2 = 0 then replace(x, chr(9), chr(1)) else x end), 'string_agg', '"'), chr(9)) as c from judged where reason is null)
select line_id, file_name, line_no, c[1] as vcf_chrom, cast(c[2] as bigint) as vcf_pos, c[3] as vcf_id, c[4] as vcf_ref, c[5] as vcf_alt,
  case when c[6] <> '.' then cast(c[6] as double) end as vcf_qual, c[7] as vcf_filter, replace(c[8], chr(1), chr(9)) as vcf_info, c[9] as vcf_format,
  case when len(c) > 9 then list_aggregate(c[10:], 'string_agg', chr(9)) end as genotype
from hidden"""
)

# A piece is a run of quoted text, of what may not be split, and of anything but delimiters.
_P3 = r"""
with once as (select distinct call_id, vcf_alt, vcf_info, vcf_format from vcf_calls),
fields as (
  select call_id, 'vcf_alt' as field_name, vcf_alt as x from once
  union all select call_id, 'vcf_info', vcf_info from once
  union all select call_id, 'vcf_format', vcf_format from once),
trimmed as (select *, regexp_replace(x, '^\s+|\s+$', '', 'g') as t from fields where x is not null),
bare as (
  select *, case when length(t) > 1 and starts_with(t, '"') and ends_with(t, '"') and length(t) - length(replace(t, '"', '')) = 2 then t[2:-2] else t end as u from trimmed),
marked as (
  select *, case when field_name = 'vcf_info' then list_aggregate(list_transform(string_split(u, '"'), lambda p, i: case when i % 2 = 1 then regexp_replace(p, ',\s*([A-Z][A-Z0-9_]*=)', ';\1', 'g') else p end), 'string_agg', '"') else u end as v
  from bare where u <> '.'),
pieces as (select call_id, field_name, list_filter(list_transform(
    case field_name when 'vcf_alt' then regexp_extract_all(v, '(?:"[^"]*"|<[^>]*>|[^",;|/\s])+') when 'vcf_info' then regexp_extract_all(v, '(?:"[^"]*"|[^";|\s])+') else regexp_extract_all(v, '(?:"[^"]*"|[^":,;|\s])+') end,
    lambda p: case when regexp_full_match(p, '([^="]*=)?".*"', 's') then replace(regexp_replace(p, '^([^="]*=)?"(.*)"$', '\1\2', 's'), '""', '"') else p end), lambda p: p <> '') as items from marked)
select distinct call_id, field_name, unnest(generate_series(1, len(items)))::int as item_no, unnest(items) as item from pieces where len(items) > 0"""

_P6 = """
with named as (
  select 'alignments' as source_table, regexp_replace(lower(trim(reference_name)), '^chr', '') as contig_key, pos, hash(a) as h from alignments a
  union all
  select 'vcf_calls', regexp_replace(lower(trim(vcf_chrom)), '^chr', ''), vcf_pos, hash(a) from vcf_calls a),
keyed as (select regexp_replace(lower(trim(contig_name)), '^chr', '') as k, contig_name from contigs),
summed as (
  select source_table, contig_key, count(*) as n_rows, count(distinct h) as n_records, min(pos) as first_pos, max(pos) as last_pos,
    quantile_disc(pos, 0.5) as median_pos from named group by 1, 2)
"""

ORACLE = {
    "p1_found": f"""
with a as ({_SIDE.format(table="vcf_sites")}), b as ({_SIDE.format(table="vcf_sites_mirror")}),
j as (select a.rec_id as x, b.rec_id as y, a.r as l, b.r as r from a full join b on a.rec_id = b.rec_id)
select y as rec_id, 'missing_in_sites' as field_name from j where x is null
union all select x, 'missing_in_mirror' from j where y is null
union all select x, 'vcf_chrom' from j where x = y and l.c is distinct from r.c
union all select x, 'vcf_pos' from j where x = y and l.p is distinct from r.p
union all select x, 'vcf_ref' from j where x = y and l.r is distinct from r.r
union all select x, 'vcf_alt' from j where x = y and l.a is distinct from r.a
union all select x, 'vcf_qual' from j where x = y and l.q is distinct from r.q and not coalesce(abs(l.q - r.q) <= 0.01 + 1e-9, false)
union all select x, 'vcf_filter' from j where x = y and l.f is distinct from r.f
union all select x, 'vcf_info' from j where x = y and l.i is distinct from r.i""",
    "p2_found": _P2 + "select line_id, reason from judged where reason is not null",
    "p2_variants": _P2_TYPED,
    "p3_found": _P3,
    "p6_contigs": _P6 + "select s.source_table, s.contig_key, k.contig_name, n_rows, n_records, first_pos, last_pos, median_pos from summed s left join keyed k on s.contig_key = k.k",
    "p6_found": _P6
    + """select s.source_table, k.contig_name from summed s join keyed k on s.contig_key = k.k
join (select source_table, sum(n_rows) as total from summed group by 1) t on s.source_table = t.source_table where n_rows * 20 >= total""",
}
