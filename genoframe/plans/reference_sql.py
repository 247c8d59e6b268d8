"""SQL twins of the domain's queries, in DuckDB's dialect."""

from __future__ import annotations

from genoframe.operators import position_sets
from genoframe.plans.settings import NAMED_RANGE, RANDOM_SHARE, RANGE, RECORD_RANGE, SEED, UNMASK_RANGE

_SITE = """
  select rec_id, r.c as vcf_chrom, r.p as vcf_pos, upper(r.r) as ref, upper(r.a) as alt, string_split(upper(r.a), ',') as alts, r.i as info from (
    select rec_id, arg_max(s, (loaded_at, s)) as r from (
      select rec_id, loaded_at, struct_pack(c := vcf_chrom, p := vcf_pos, r := vcf_ref, a := vcf_alt, q := vcf_qual, f := vcf_filter, i := vcf_info) as s from {table}) group by rec_id)"""

_UNQUOTE = r"""lambda p: case when regexp_full_match(p, '([^="]*=)?".*"', 's') then replace(regexp_replace(p, '^([^="]*=)?"(.*)"$', '\1\2', 's'), '""', '"') else p end"""

_PRELUDE = rf"""
with recursive ctg as (select contig_id, contig_name, regexp_replace(lower(trim(contig_name)), '^chr', '') as k, start_idx as cs, contig_length from contigs),
aln as (select * from alignments qualify row_number() over (partition by ord order by qname) = 1),
rd as (
  select ord, qname, cigar, seq, qual, sample_id, contig_name, cs is not null and (flag & 4) = 0 and coalesce(pos, 0) > 0 as mapped,
    case when (flag & 4) = 0 and pos > 0 then cs + pos - 1 end as start_idx,
    case when (flag & 4) = 0 and pos > 0 then cast(cs + pos - 2 + coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: cast(x as bigint))), 0) as bigint) end as end_idx
  from aln left join ctg on regexp_replace(lower(trim(reference_name)), '^chr', '') = k),
site_rows as ({_SITE.format(table="vcf_sites")}),
mirror_rows as ({_SITE.format(table="vcf_sites_mirror")}),
site as (
  select s.*, contig_name, cs + vcf_pos - 1 as idx,
    case when regexp_matches(info, '(^|;)AC=[0-9]+(,[0-9]+)*(;|$)') then list_transform(string_split(regexp_extract(info, '(^|;)AC=([^;]*)', 2), ','), lambda x: cast(x as bigint)) end as ac,
    case when regexp_matches(info, '(^|;)AN=[0-9]+(;|$)') then cast(regexp_extract(info, '(^|;)AN=([^;]*)', 2) as bigint) end as an
  from site_rows s join ctg on regexp_replace(lower(trim(vcf_chrom)), '^chr', '') = k),
listed as (select *, list_concat([ref], list_filter(alts, lambda a: a <> '.')) as al from site),
kinds as (
  select *, list_aggregate(list_transform(al, lambda a: regexp_full_match(a, '[ATGC]')), 'bool_and') as snv,
    list_aggregate(list_transform(al, lambda a: regexp_full_match(a, '[ATGC]*')), 'bool_and') and list_aggregate(list_transform(al, lambda a: length(a) >= 2), 'bool_or') as indel,
    list_aggregate(list_transform(al, lambda a: left(a, 1) = left(ref, 1)), 'bool_and') as same_first from listed),
judged as (
  select *, case when al is null or len(al) < 2 then 'incomplete' when not (snv or indel) then 'unknown' when not snv and not same_first then 'first_base'
    when ac is null or an is null or len(ac) <> len(al) - 1 then 'no_info' when list_sum(ac) = 0 then 'no_alternative' when an - list_sum(ac) < 0 then 'negative'
    when snv then 'snv' else 'indel' end as status from kinds),
usable as (select *, list_concat([cast(an - list_sum(ac) as bigint)], ac) as counts from judged where status in ('snv', 'indel') and idx is not null qualify row_number() over (partition by idx order by rec_id) = 1),
snvs as (
  select idx, cast(instr('ATGC', ref) - 1 as int) as ref_id,
    coalesce(list_extract(counts, len(al) + 1 - nullif(list_position(list_reverse(al), 'A'), 0)), 0) as n_a, coalesce(list_extract(counts, len(al) + 1 - nullif(list_position(list_reverse(al), 'T'), 0)), 0) as n_t,
    coalesce(list_extract(counts, len(al) + 1 - nullif(list_position(list_reverse(al), 'G'), 0)), 0) as n_g, coalesce(list_extract(counts, len(al) + 1 - nullif(list_position(list_reverse(al), 'C'), 0)), 0) as n_c
  from usable where status = 'snv'),
ops as (select ord, start_idx, end_idx, seq, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) as o, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), 1) as i from rd where mapped),
opn as (select *, cast(regexp_extract(o, '[0-9]+') as bigint) as n, right(o, 1) as op from ops),
blk as (
  select *, coalesce(sum(case when op in ('M', 'D', 'N', '=', 'X') then n else 0 end) over w, 0) as roff, coalesce(sum(case when op in ('M', 'I', 'S', '=', 'X') then n else 0 end) over w, 0) as soff, coalesce(sum(n) over w, 0) as uoff
  from opn window w as (partition by ord order by i rows between unbounded preceding and 1 preceding)),
covers as (select r.ord, v.idx, r.start_idx, r.seq, r.sample_id from rd r join (select distinct idx from site) v on v.idx between r.start_idx and r.end_idx where r.mapped),
cell as (
  select r.ord, r.sample_id, v.idx, v.n_a, v.n_t, v.n_g, v.n_c, v.ref_id, cast(b.soff + v.idx - r.start_idx - b.roff as int) as seq_pos, cast(b.uoff + v.idx - r.start_idx - b.roff as int) as unit,
    nullif(regexp_extract(substr(r.seq, cast(b.soff + v.idx - r.start_idx - b.roff + 1 as bigint), 1), '[ATGC]'), '') as allele
  from rd r join snvs v on v.idx between r.start_idx and r.end_idx
    left join blk b on b.ord = r.ord and b.op in ('M', '=', 'X') and v.idx - r.start_idx >= b.roff and v.idx - r.start_idx < b.roff + b.n
  where r.mapped),
counted as (
  select sample_id, idx, count(*) filter (allele = 'A') as n_a, count(*) filter (allele = 'T') as n_t, count(*) filter (allele = 'G') as n_g, count(*) filter (allele = 'C') as n_c from cell where allele is not null group by sample_id, idx),
passed as (
  select sample_id, idx, list_filter(['A', 'T', 'G', 'C'], lambda b, i: [n_a, n_t, n_g, n_c][i] / cast(n_a + n_t + n_g + n_c as double) >= 0.2) as p from counted),
called as (select sample_id, idx, case when len(p) in (1, 2) then p[1] end as allele_a, case when len(p) in (1, 2) then p[-1] end as allele_b from passed),
draws as (
  select c.sample_id, c.idx, allele_a, allele_b, ref_id, n_a, n_t, n_g, n_c, n_a + n_t + n_g + n_c as t,
    cast('0x' || substr(md5(concat_ws(':', '{SEED}:a', c.idx, c.sample_id)), 1, 8) as bigint) / 4294967296.0 as ua, cast('0x' || substr(md5(concat_ws(':', '{SEED}:b', c.idx, c.sample_id)), 1, 8) as bigint) / 4294967296.0 as ub
  from called c join snvs v on c.idx = v.idx),
drawn as (
  select *, case when n_a > ua * t then 'A' when n_a + n_t > ua * t then 'T' when n_a + n_t + n_g > ua * t then 'G' else 'C' end as to_a,
    case when n_a > ub * t then 'A' when n_a + n_t > ub * t then 'T' when n_a + n_t + n_g > ub * t then 'G' else 'C' end as to_b from draws),
zyg as (
  select *, case when allele_a = allele_b then case when to_a = to_b then 0 else 1 end when to_a <> to_b then 2 else 3 end as zygosity from drawn where allele_a is not null),
mask as (
  select sample_id, idx, ref_id, allele_a, allele_b, to_a, to_b, zygosity,
    case when zygosity = 2 then case
        when (allele_a = to_a and allele_b = to_b) or (allele_a = to_b and allele_b = to_a) then 'ATGC'
        when allele_a = to_a then translate('ATGC', allele_b || to_b, to_b || allele_b) when allele_a = to_b then translate('ATGC', allele_b || to_a, to_a || allele_b)
        when allele_b = to_a then translate('ATGC', allele_a || to_b, to_b || allele_a) when allele_b = to_b then translate('ATGC', allele_a || to_a, to_a || allele_a)
        else translate('ATGC', allele_a || to_a || allele_b || to_b, to_a || allele_a || to_b || allele_b) end
      else translate('ATGC', allele_a || to_a, to_a || allele_a) end as perm_a,
    case zygosity when 1 then translate('ATGC', allele_a || to_b, to_b || allele_a) when 3 then translate('ATGC', allele_b || to_a, to_a || allele_b) end as perm_2 from zyg),
masks as (select * exclude (perm_2), coalesce(perm_2, perm_a) as perm_b from mask),
chosen as (
  select c.ord, c.sample_id, c.idx, c.ref_id, c.seq_pos, c.allele, m.zygosity, m.perm_a, m.perm_b,
    case m.zygosity when 1 then cast('0x' || substr(md5(concat('{SEED}:beta:', c.idx, ':', c.ord)), 1, 8) as bigint) / 4294967296.0 >= 0.5 when 3 then coalesce(c.allele = m.allele_b, false) else false end as use_b
  from cell c join masks m on c.idx = m.idx and c.sample_id is not distinct from m.sample_id),
mcell as (select *, translate(allele, 'ATGC', case when use_b then perm_b else perm_a end) as masked from chosen),
indels as (select idx, al, counts from usable where status = 'indel'),
icover as (
  select r.ord, r.sample_id, r.seq, v.idx, v.al, v.al[1] as ra, cast(b.soff + v.idx - r.start_idx - b.roff as int) as seq_pos, cast(b.uoff + v.idx - r.start_idx - b.roff as int) as unit,
    list_aggregate(list_transform(regexp_extract_all(r.cigar, '[0-9]+[MIDNSHP=X]'), lambda x: repeat(right(x, 1), cast(regexp_extract(x, '[0-9]+') as int))), 'string_agg', '') as units
  from rd r join indels v on v.idx between r.start_idx and r.end_idx
    left join blk b on b.ord = r.ord and b.op in ('M', '=', 'X') and v.idx - r.start_idx >= b.roff and v.idx - r.start_idx < b.roff + b.n
  where r.mapped),
itry as (
  select *, substr(units, unit + 1) as rest, repeat('M', cast(least(length(a), length(ra)) as int)) || repeat(case when length(a) > length(ra) then 'I' else 'D' end, cast(abs(length(a) - length(ra)) as int)) as own
  from (select *, unnest(al) as a, generate_subscripts(al, 1) as ai from icover where seq_pos is not null)),
ijudged as (
  select *, substr(rest, length(own) + 1, 1) as after, left(own, cast(least(length(own), length(rest)) as bigint)) = left(rest, cast(least(length(own), length(rest)) as bigint)) as agrees from itry),
iend as (
  select ord, idx, arg_min((a, stopped), (-length(a), -ai)) as e from (
    select *, length(own) > length(rest) or (right(own, 1) = 'I' and after = 'I') or (right(own, 1) = 'D' and after = 'D') or (right(own, 1) = 'M' and after in ('I', 'D')) as stopped from ijudged where agrees)
  where stopped or substr(seq, seq_pos + 1, length(a)) = a group by ord, idx),
icell as (
  select c.ord, c.sample_id, c.idx, c.ra, c.seq_pos, c.unit, case when not e[2] and length(units) > unit + greatest(length(e[1]), length(ra)) then e[1] end as allele from icover c left join iend e on c.ord = e.ord and c.idx = e.idx),
iseen as (select sample_id, idx, allele, count(*) as n from icell where allele is not null group by all),
inamed as (
  select p.sample_id, v.idx, len(v.al) as k, list_sort(list_transform(v.al, lambda a, i: struct_pack(a := a, w := v.counts[i]))) as named, p.seen
  from indels v join (select sample_id, idx, map(list(allele), list(n)) as seen from iseen group by 1, 2) p on v.idx = p.idx),
idrawn as (
  select *, list_transform(range(1, 2 * k + 1), lambda t: cast('0x' || substr(md5(concat_ws(':', '{SEED}:indel', idx, t, sample_id)), 1, 8) as bigint) / 4294967296.0) as u from inamed),
iranked as (select sample_id, idx, k, u, named, list_sort(list_transform(named, lambda x, i: struct_pack(s := -(coalesce(seen[x.a], 0) + u[i]), a := x.a))) as sources from idrawn),
ipair as (select sample_id, idx, k, u, sources, 0 as turn, named as remaining, '' as allele, '' as image from iranked),
diff as (select sample_id, idx, ref_id, zygosity, perm_a, perm_b from mcell group by all having bool_or(allele <> masked)),
edits as (select ord, list(struct_pack(p := seq_pos, m := masked) order by seq_pos) as e from mcell where allele <> masked group by ord),
call_rows as (
  select *, regexp_replace(vcf_format, '^\s+|\s+$', '', 'g') as f0, regexp_replace(vcf_alt, '^\s+|\s+$', '', 'g') as a0
  from (select distinct call_id, sample_id, vcf_kind, vcf_chrom, vcf_pos, vcf_ref, vcf_alt, vcf_qual, vcf_filter, vcf_format, genotype from vcf_calls)),
call_bare as (
  select *, case when length(f0) > 1 and starts_with(f0, '"') and ends_with(f0, '"') and length(f0) - length(replace(f0, '"', '')) = 2 then f0[2:-2] else f0 end as f1,
    case when length(a0) > 1 and starts_with(a0, '"') and ends_with(a0, '"') and length(a0) - length(replace(a0, '"', '')) = 2 then a0[2:-2] else a0 end as a1 from call_rows),
call_lists as (
  select *, case when f1 <> '.' then list_filter(list_transform(regexp_extract_all(f1, '(?:"[^"]*"|[^":,;|\s])+'), {_UNQUOTE}), lambda p: p <> '') else [] end as keys,
    case when a1 <> '.' then list_transform(list_filter(list_transform(regexp_extract_all(a1, '(?:"[^"]*"|<[^>]*>|[^",;|/\s])+'), {_UNQUOTE}), lambda p: p <> ''), lambda p: upper(p)) else [] end as alleles from call_bare),
calls as (
  select c.*, contig_name, cs + vcf_pos - 1 as idx,
    try_cast(list_extract(string_split(genotype, ':'), nullif(list_position(keys, 'DP'), 0)) as int) as depth,
    try_cast(list_extract(string_split(genotype, ':'), nullif(list_position(keys, 'VAF'), 0)) as double) as freq,
    list_extract(string_split(genotype, ':'), nullif(list_position(keys, 'GT'), 0)) as gt
  from call_lists c join ctg on regexp_replace(lower(trim(vcf_chrom)), '^chr', '') = k),
member as (
  select idx, bool_or(vcf_kind = 'population') as in_population, bool_or(vcf_kind = 'personal') as in_personal, bool_or(vcf_kind = 'masked') as in_masked
  from calls where idx is not null and vcf_kind in ('population', 'personal', 'masked') group by idx),
classed as (
  select *, case when in_population and in_personal and in_masked then 'not_masked' when in_population and in_personal then 'masked' when in_population and in_masked then 'introduced'
    when in_personal and in_masked then 'not_covered' when in_population then 'not_found' when in_personal then 'hidden' else 'revealed' end as class from member),
bins as (
  select vcf_kind, (freq >= 0.1)::int + (freq >= 0.2)::int + (freq >= 0.3)::int + (freq >= 0.4)::int + (freq >= 0.5)::int + (freq >= 0.6)::int + (freq >= 0.7)::int + (freq >= 0.8)::int + (freq >= 0.9)::int as bin, count(*) as n
  from calls where freq between 0 and 1 group by 1, 2)
"""

_SIZES = {"union": "true", "population": "in_population", "personal": "in_personal", "masked_set": "in_masked", "population_personal": "in_population and in_personal", "personal_masked": "in_personal and in_masked", "population_masked": "in_population and in_masked"}
_SIZES |= {c: f"class = '{c}'" for c in position_sets.CLASSES.values()}



def _named(text: str) -> list[str]:
    """First and last index of ``name:pos:name:pos``."""
    name, pos, to, upto = text.split(":")
    return [f"(select cs + {p} - 1 from ctg where contig_name = '{n}')" for n, p in ((name, pos), (to, upto))]


_NAMED, _RECORDS, _UNMASKED = _named(NAMED_RANGE), _named(RECORD_RANGE), _named(UNMASK_RANGE)
_SCAN = "select ord, qname, mapped, contig_name, start_idx, end_idx from rd where "
_ONE_CALL = "select idx, min((vcf_alt, freq)) as c from calls where vcf_kind = '{0}' group by idx"

# One source allele a turn goes to a target drawn by weight from those left.
_BIJECTION = """, ibij as (
  select * from ipair
  union all
  select sample_id, idx, k, u, sources, turn + 1, list_concat(remaining[1:pick - 1], remaining[pick + 1:]), sources[turn + 1].a, remaining[pick].a from (
    select *, coalesce(case when list_sum(list_transform(remaining, lambda x: x.w)) > 0 then
        list_filter(range(1, len(remaining) + 1), lambda t: list_sum(list_transform(remaining[1:t], lambda x: x.w)) > (case when len(remaining) > 1 then u[k + turn + 1] else 0 end) * list_sum(list_transform(remaining, lambda x: x.w)))[1]
      else least(cast(floor((case when len(remaining) > 1 then u[k + turn + 1] else 0 end) * len(remaining)) as bigint), len(remaining) - 1) + 1 end, len(remaining)) as pick
    from ibij where turn < k))
"""


# The prelude over known and random variants that are left when none may begin within the last
# kept one's reference, with indels told only where no other one follows.
_RUN = (
    _PRELUDE.replace("usable as (", "usable_known as (", 1)
    .replace(
        "snvs as (\n",
        f"""extent as (select min(cs) as a, max(cs + contig_length) - 1 as b from ctg),
random_idx as (select distinct cast(floor(cast('0x' || substr(md5(concat('{SEED}:random:', i)), 1, 8) as bigint) / 4294967296.0 * (b - a)) as bigint) + a as idx from extent, range(0, cast(floor({RANDOM_SHARE} * (b - a)) as bigint)) r(i)),
merged as (
  select idx, ref, al, counts, status from usable_known
  union all select idx, 'A', ['A', 'T', 'G', 'C'], [3::bigint, 3, 2, 2], 'snv' from random_idx where idx not in (select idx from usable_known)),
spans as (select c.contig_name, m.idx, cast(length(m.ref) as bigint) as length from merged m join ctg c on m.idx >= c.cs and m.idx < c.cs + c.contig_length),
span_lists as (select contig_name, list(struct_pack(s := idx, free := idx + length, kept := [idx]) order by idx) as l from spans group by contig_name),
kept as (
  select unnest(list_reduce(l, lambda acc, x: case when x.s >= acc.free then struct_pack(s := x.s, free := x.free, kept := list_concat(acc.kept, x.kept)) else acc end).kept) as idx from span_lists),
usable as (select * from merged where idx in (select idx from kept)),
snvs as (
""",
        1,
    )
    .replace("then e[1] end as allele from icover", "and substr(units, unit + greatest(length(e[1]), length(ra)) + 1, 1) not in ('I', 'D') then e[1] end as allele from icover", 1)
)


def _genotyped(cells: str, base: str) -> str:
    """Genotypes called from a column of cells, with the share of bases unlike the reference."""
    counts = ", ".join(f"count(*) filter ({base} = '{b}') as n_{b.lower()}" for b in "ATGC")
    return f"""
  select sample_id, idx, p[1] || '/' || p[-1] as alt, 1 - [n_a, n_t, n_g, n_c][ref_id + 1] / cast(n_a + n_t + n_g + n_c as double) as freq from (
    select *, list_filter(['A', 'T', 'G', 'C'], lambda b, i: [n_a, n_t, n_g, n_c][i] / cast(n_a + n_t + n_g + n_c as double) >= 0.2) as p from (
      select sample_id, idx, ref_id, {counts} from {cells} where {base} is not null group by sample_id, idx, ref_id)) where len(p) in (1, 2)"""


_TWICE = f", personal as ({_genotyped('mcell', 'allele')}), masked_again as ({_genotyped('mcell', 'masked')}) "

ORACLE = {
    name: _PRELUDE + sql
    for name, sql in {
        "contig_starts": """, starts as (select contig_name, cast(coalesce(sum(contig_length) over (order by contig_id rows between unbounded preceding and 1 preceding), 0) as bigint) as start_idx from ctg)
select t.contig_name, any_value(t.start_idx) as start_idx, count(*) as n_sites, min(t.start_idx + s.vcf_pos - 1) as first_idx, max(t.start_idx + s.vcf_pos - 1) as last_idx from site s join starts t on s.contig_name = t.contig_name group by 1""",
        "site_indices": "select rec_id, contig_name, vcf_pos, idx from site",
        "index_positions": "select s.rec_id, s.idx, c.contig_name, s.idx - c.cs + 1 as ref_pos from site s join ctg c on s.idx >= c.cs and s.idx < c.cs + c.contig_length",
        "scan_mapped": _SCAN + "mapped",
        "scan_range": _SCAN + f"mapped and end_idx >= {RANGE[0]} and start_idx < {RANGE[1]}",
        "scan_named_range": _SCAN + f"mapped and end_idx >= {_NAMED[0]} and start_idx <= {_NAMED[1]}",
        "scan_unmapped": _SCAN + "not mapped",
        "scan_range_unmapped": _SCAN + f"not mapped or end_idx >= {RANGE[0]} and start_idx <= {RANGE[1]}",
        "covering_counts": "select idx, count(*) as n_reads from covers group by idx",
        "covering_read_count": "select sample_id, count(distinct ord) as n_covering from covers group by sample_id",
        "pileup_cells": "select ord, idx, seq_pos, unit, allele from cell",
        "pileup_counts": "select sample_id, idx, n_a, n_t, n_g, n_c from counted",
        "genotype_calls": "select sample_id, idx, allele_a, allele_b from called",
        "allele_count_snvs": "select idx, ref_id, n_a, n_t, n_g, n_c from snvs",
        "allele_count_indels": "select idx, cast(unnest(range(len(al))) as int) as allele_no, unnest(al) as seq, unnest(counts) as n from usable where status = 'indel'",
        "allele_count_counters": """select count(*) as n_rows, count(*) filter (status = 'incomplete') as n_incomplete, count(*) filter (status = 'unknown') as n_unknown, cast(0 as bigint) as n_skipped,
  count(*) filter (status = 'first_base') as n_first_base, count(*) filter (status = 'no_info') as n_no_info, count(*) filter (status = 'no_alternative') as n_no_alternative, count(*) filter (status = 'negative') as n_negative,
  (select count(*) from usable where status = 'snv') as n_snv, (select count(*) from usable where status = 'indel') as n_indel,
  count(*) filter (status in ('snv', 'indel') and idx is not null) - (select count(*) from usable) as n_same_index from judged""",
        "allele_count_text": """select 0 as block, 0::bigint as idx, count(*)::varchar as line from snvs union all select 0, 1, count(*)::varchar from usable where status = 'indel'
union all select 1, idx, concat_ws(chr(9), idx, ref_id, concat_ws(',', n_a, n_t, n_g, n_c)) from snvs
union all select 2, idx, concat(idx, chr(9), list_aggregate(list_transform(al, lambda a, i: concat(counts[i], ':', a)), 'string_agg', ',')) from usable where status = 'indel'""",
        "reference_mismatches": """select s.rec_id, s.idx, left(s.ref, 1) as base from site s join
  (select cs + vcf_pos - 1 as idx, list(distinct left(ref, 1)) as b from mirror_rows join ctg on regexp_replace(lower(trim(vcf_chrom)), '^chr', '') = k group by 1) o on s.idx = o.idx where not list_contains(o.b, left(s.ref, 1))""",
        "reference_alleles": """, shown as (
  select start_idx + roff + t as idx, substr(seq, cast(soff + t + 1 as bigint), 1) as base from (select *, unnest(range(cast(n as bigint))) as t from blk where op in ('M', '=', 'X'))),
best as (select idx, arg_max(base, (n, -instr('ATGC', base))) as base from (select idx, base, count(*) as n from shown where base in ('A', 'T', 'G', 'C') group by 1, 2) group by 1),
wanted as (select idx, al, list_max(list_transform(al, lambda a: length(a))) as longest from usable),
spelled as (
  select w.idx, any_value(w.al) as al, string_agg(coalesce(b.base, '?'), '' order by w.at) as bases from (select *, idx + unnest(range(longest)) as at from wanted) w left join best b on b.idx = w.at group by w.idx)
select idx, bases, cast(nullif(list_position(list_transform(al, lambda a: left(bases, length(a)) = a), true), 0) - 1 as int) as allele_no from spelled""",
        "merged_variants": f""", extent as (select min(cs) as a, max(cs + contig_length) - 1 as b from ctg),
known as (
  select idx, true as is_snv, substr('ATGC', ref_id + 1, 1) as ref_allele, 'A,T,G,C' as alleles, concat_ws(',', n_a, n_t, n_g, n_c) as counts from snvs
  union all select idx, false, ref, array_to_string(al, ','), array_to_string(counts, ',') from usable where status = 'indel'),
drawn_idx as (select distinct cast(floor(cast('0x' || substr(md5(concat('{SEED}:random:', i)), 1, 8) as bigint) / 4294967296.0 * (b - a)) as bigint) + a as idx from extent, range(0, cast(floor({RANDOM_SHARE} * (b - a)) as bigint)) r(i))
select * from known union all select idx, true, 'A', 'A,T,G,C', '3,3,2,2' from drawn_idx where idx not in (select idx from known)""",
        "kept_variants": """, spans as (
  select c.contig_name, u.idx, cast(length(u.ref) as bigint) as length from (select idx, ref from usable) u join ctg c on u.idx >= c.cs and u.idx < c.cs + c.contig_length),
lists as (select contig_name, list(struct_pack(s := idx, free := idx + length, kept := [struct_pack(idx := idx, length := length)]) order by idx) as l from spans group by contig_name),
folded as (
  select contig_name, list_reduce(l, lambda acc, x: case when x.s >= acc.free then struct_pack(s := x.s, free := x.free, kept := list_concat(acc.kept, x.kept)) else acc end).kept as kept from lists),
each as (select contig_name, unnest(kept) as v from folded)
select contig_name, v.idx as idx, v.length as length from each""",
        "overlap_clusters": """, spans as (select idx, max(length(ref)) as length from site where idx is not null group by idx),
marked as (select *, coalesce(idx >= max(idx + length) over (order by idx rows between unbounded preceding and 1 preceding), true) as b from spans)
select idx, length, max(case when b then idx end) over (order by idx) as cluster from marked""",
        "genotype_masks": "select sample_id, idx, allele_a, allele_b, to_a, to_b, zygosity, perm_a, perm_b from masks",
        "zygosity_changes": "select sample_id, zygosity, count(*) as n from masks group by all",
        "masked_cells": "select ord, idx, allele, use_b, masked from mcell",
        "difference_records": "select * from diff",
        "mask_codes": "select sample_id, idx, cast(list_sum(list_transform([0, 1, 2, 3], lambda i: (instr('ATGC', substr(perm_a, i + 1, 1)) - 1) * (1 << (2 * i)))) as int) as code_a, perm_a from diff",
        "difference_slice": f"select * from diff where idx between {_RECORDS[0]} and {_RECORDS[1]}",
        "difference_bounds": f"select sample_id, min(idx) as first_idx, max(idx) as last_idx, min(idx) filter (idx >= {_RECORDS[1]}) as at_or_after, max(idx) filter (idx <= {_RECORDS[1]}) as at_or_before from diff group by sample_id",
        "run_counters": """, by_reads as (select sample_id, count(*) as n from rd group by 1),
by_cover as (select r.sample_id, count(distinct r.ord) as n from rd r join snvs v on v.idx between r.start_idx and r.end_idx where r.mapped group by 1),
by_change as (select sample_id, count(*) as c, count(distinct ord) as r, count(distinct idx) as i from mcell where allele <> masked group by 1)
select r.sample_id, r.n as n_reads, coalesce(c.n, 0) as n_covering, (select count(*) from snvs) as n_variants, coalesce(m.c, 0) as n_changed_cells, coalesce(m.r, 0) as n_changed_reads, coalesce(m.i, 0) as n_records
from by_reads r left join by_cover c on r.sample_id is not distinct from c.sample_id left join by_change m on r.sample_id is not distinct from m.sample_id""",
        "masked_reads": """select r.ord, case when e is null then r.seq else list_reduce(list_prepend(r.seq, list_transform(e, lambda x: x.p || ':' || x.m)), lambda s, x: left(s, cast(string_split(x, ':')[1] as bigint)) || string_split(x, ':')[2] || substr(s, cast(string_split(x, ':')[1] as bigint) + 2)) end as seq,
  r.cigar, r.qual from rd r left join edits d on r.ord = d.ord""",
        "unmasked_reads": "select ord, seq, cigar, qual, ord in (select ord from edits) as was_masked from rd",
        "ciphered_reads": """select ord, list_aggregate(list_transform(string_split(seq, ''), lambda b, i: case when b = 'N' then b else
  substr('ATGC', xor(instr('ATGC', b) - 1, (cast('0x' || substr(md5('s:' || qname), cast((i - 1) // 2 % 32 + 1 as bigint), 1) as bigint) >> (case when i % 2 = 1 then 2 else 0 end)) & 3) + 1, 1) end), 'string_agg', '') as seq
from rd where not mapped and regexp_full_match(seq, '[ATGCN]+')
union all select ord, case when seq = '' then '' end from rd where not mapped and not coalesce(regexp_full_match(seq, '[ATGCN]+'), false)""",
        "unmask_all": "select ord, seq, cigar from rd where mapped",
        "unmask_range": f"select ord, seq, cigar from rd where mapped and end_idx >= {_UNMASKED[0]} and start_idx <= {_UNMASKED[1]}",
        "unmask_range_unmapped": f"select ord, seq, cigar from rd where not mapped or end_idx >= {_UNMASKED[0]} and start_idx <= {_UNMASKED[1]}",
        "unmask_unmapped": "select ord, seq, cigar from rd where not mapped",
        "indel_pileup": "select ord, idx, seq_pos, unit, allele from icell",
        "indel_masks": _BIJECTION + "select sample_id, idx, allele, image from ibij where turn > 0",
        "indel_masked_reads": _BIJECTION
        + """, imask as (select sample_id, idx, allele, image from ibij where turn > 0),
ichange as (
  select c.ord, list(struct_pack(p := c.seq_pos, un := c.unit, o := c.allele, n := m.image, r := c.ra) order by c.seq_pos desc) as e
  from icell c join imask m on c.idx = m.idx and c.sample_id is not distinct from m.sample_id and c.allele = m.allele where m.image <> m.allele group by c.ord),
iedit as (
  select r.ord, r.seq, r.qual, list_aggregate(list_transform(regexp_extract_all(r.cigar, '[0-9]+[MIDNSHP=X]'), lambda x: repeat(right(x, 1), cast(regexp_extract(x, '[0-9]+') as int))), 'string_agg', '') as units, e, 0 as turn
  from rd r join ichange c on r.ord = c.ord
  union all
  select ord, left(seq, cast(x.p as bigint)) || x.n || substr(seq, x.p + length(x.o) + 1),
    case when qual = '*' or more = 0 then qual when more > 0 then left(qual, cast(x.p + length(x.o) as bigint)) || repeat(chr(cast(ceil(list_avg(list_transform(string_split(qual, ''), lambda q: ascii(q)))) as int)), more) || substr(qual, x.p + length(x.o) + 1)
      else left(qual, cast(x.p + length(x.o) + more as bigint)) || substr(qual, x.p + length(x.o) + 1) end,
    left(units, cast(x.un as bigint)) || repeat('M', cast(least(length(x.n), length(x.r)) as int)) || repeat(case when length(x.n) > length(x.r) then 'I' else 'D' end, cast(abs(length(x.n) - length(x.r)) as int)) || substr(units, x.un + greatest(length(x.o), length(x.r)) + 1),
    e, turn + 1
  from (select *, e[turn + 1] as x, cast(length(e[turn + 1].n) - length(e[turn + 1].o) as int) as more from iedit where turn < len(e)))
select r.ord, coalesce(d.seq, r.seq) as seq, coalesce(d.cigar, r.cigar) as cigar, coalesce(d.qual, r.qual) as qual from rd r left join (
  select ord, seq, qual, list_aggregate(list_transform(regexp_extract_all(units, 'M+|I+|D+|N+|S+|H+|P+|=+|X+'), lambda x: length(x) || left(x, 1)), 'string_agg', '') as cigar from iedit where turn = len(e)) d on r.ord = d.ord""",
        "secret_ciphers_checked": "select ord, case when regexp_full_match(seq, '[ATGCN]*') then regexp_matches(seq, '[ATGC]') end as changed, case when regexp_full_match(seq, '[ATGCN]*') then true end as restored from rd where not mapped",
        "altered_genotypes": _TWICE + """select p.sample_id, p.idx, p.alt as alt_personal, m.alt as alt_masked, p.freq as freq_personal, m.freq as freq_masked, p.alt <> m.alt or p.freq <> m.freq as altered
from personal p join masked_again m on p.idx = m.idx and p.sample_id is not distinct from m.sample_id""",
        "altered_genotype_counts": _TWICE + """select p.sample_id, count(*) as n, count(*) filter (p.alt <> m.alt or p.freq <> m.freq) as n_altered, count(*) filter (p.alt = m.alt and p.freq = m.freq) as n_same, n_altered * 100.0::double / n as percent_altered
from personal p join masked_again m on p.idx = m.idx and p.sample_id is not distinct from m.sample_id group by 1""",
        "genotype_classes": _TWICE + """, flags as (
  select idx, true as in_population, idx in (select idx from personal where freq > 0) as in_personal, idx in (select idx from masked_again where freq > 0) as in_masked from snvs)
select *, case when in_personal and in_masked then 'not_masked' when in_personal then 'masked' when in_masked then 'introduced' else 'not_found' end as class from flags""",
        "cohort_genotypes": """, listed_gt as (select concat_ws(':', contig_name, vcf_pos, vcf_ref, vcf_alt) as site_id, sample_id, max(gt) as gt from calls where gt <> '' and sample_id is not null group by 1, 2),
names as (select list_sort(list(distinct sample_id)) as s from listed_gt), by_site as (select site_id, map(list(sample_id), list(gt)) as m from listed_gt group by 1)
select site_id, array_to_string(list_transform(s, lambda x: coalesce(m[x], '0/0')), ' ') as genotypes from by_site, names""",
        "sample_components_checked": """select unnest([1, 2])::int as component, count(distinct sample_id) as n_samples, true as unit, true as in_order
from (select *, unnest(alleles) as a from calls) where regexp_full_match(a, '[ATGC]') and gt is not null and sample_id is not null""",
        "packed_reads": """select ord, list_aggregate(list_transform(range(0, (length(seq) + 3) // 4 * 2), lambda i: substr('0123456789ABCDEF', (coalesce(nullif(instr('ATGC', substr(rpad(seq, cast((length(seq) + 3) // 4 * 4 as int), 'A'), 2 * i + 1, 1)), 0), 1) - 1) * 4
  + coalesce(nullif(instr('ATGC', substr(rpad(seq, cast((length(seq) + 3) // 4 * 4 as int), 'A'), 2 * i + 2, 1)), 0), 1), 1)), 'string_agg', '') as packed, seq from rd where regexp_full_match(seq, '[ATGC]+')
union all select ord, case when seq = '' then '' end, seq from rd where not coalesce(regexp_full_match(seq, '[ATGC]+'), false)""",
        "cigar_lengths": """select ord, list_aggregate(list_transform(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), lambda x: repeat(right(x, 1), cast(regexp_extract(x, '[0-9]+') as int))), 'string_agg', '') as expanded, cigar as shrunk,
  cast(end_idx - start_idx + 1 as int) as on_reference, cast(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MIS=X]', 1), lambda x: cast(x as int))) as int) as on_read from rd where mapped""",
        "sam_text": "select ord, concat_ws(chr(9), coalesce(qname, '*'), coalesce(flag, 0), coalesce(reference_name, '*'), coalesce(pos, 0), coalesce(mapq, 0), coalesce(cigar, '*'), coalesce(rnext, '*'), coalesce(pnext, 0), coalesce(tlen, 0), coalesce(seq, '*'), coalesce(qual, '*')) as line from aln",
        "passing_calls": "select call_id, idx, vcf_kind, depth, freq from calls where vcf_filter = 'PASS' and depth > 30 and vcf_qual > 30",
        "position_classes": "select idx, in_population, in_personal, in_masked, class from classed",
        "position_set_sizes": " union all ".join(f"select '{n}' as name, count(*) filter ({c}) as n, count(*) filter ({c}) * 100.0::double / nullif(count(*), 0) as percent from classed" for n, c in _SIZES.items()),
        "frequency_histogram": "select vcf_kind, bin, n from bins",
        "masked_bin_shares": "select bin, coalesce(sum(n) filter (vcf_kind = 'masked'), 0)::bigint as n_part, coalesce(sum(n) filter (vcf_kind in ('masked', 'personal')), 0)::bigint as n_whole, n_part / nullif(n_whole, 0)::double as share from bins group by bin",
        "altered_calls": f"""select a.idx, a.c[1] as alt_personal, b.c[1] as alt_masked, a.c[2] as freq_personal, b.c[2] as freq_masked, (a.c[1] is distinct from b.c[1] or a.c[2] is distinct from b.c[2]) as altered
from ({_ONE_CALL.format("personal")}) a join ({_ONE_CALL.format("masked")}) b on a.idx = b.idx""",
        "personal_population_calls": "select call_id, idx from calls where vcf_kind = 'personal' and idx in (select idx from site)",
        "split_sites": """select concat_ws(':', contig_name, vcf_pos, ref, a) as site_id, cast(min(i) as int) as alt_no from (select *, unnest(alts) as a, generate_subscripts(alts, 1) as i from site) where length(ref) = 1 and regexp_full_match(a, '[ATGC]') group by 1""",
        "sample_dosages": """select concat_ws(':', contig_name, vcf_pos, vcf_ref, a) as site_id, sample_id, max(len(list_filter(regexp_extract_all(gt, '[0-9]+'), lambda x: cast(x as bigint) = i)))::int as dosage
from (select *, unnest(alleles) as a, generate_subscripts(alleles, 1) as i from calls) where regexp_full_match(a, '[ATGC]') and gt is not null and sample_id is not null group by 1, 2""",
    }.items()
}

ORACLE["mask_run_records"] = (
    _RUN
    + _BIJECTION
    + """, isite as (select sample_id, idx, list(image order by allele) as m from ibij where turn > 0 group by 1, 2),
ichanged as (
  select distinct c.sample_id, c.idx, c.ra from icell c join ibij b on c.idx = b.idx and c.sample_id is not distinct from b.sample_id and c.allele = b.allele where b.turn > 0 and b.image <> b.allele),
second as (select sample_id, idx, string_agg(ord, ',' order by ord) as reads from mcell where use_b group by 1, 2)
select d.sample_id, d.idx, concat_ws(chr(9), d.idx, 1, ref_id, zygosity, array_to_string(string_split(perm_a, ''), ','), case when zygosity in (1, 3) then array_to_string(string_split(perm_b, ''), ',') end,
  case when zygosity in (1, 3) then coalesce(reads, '') end) as line from diff d left join second b on d.idx = b.idx and d.sample_id is not distinct from b.sample_id
union all select c.sample_id, c.idx, concat_ws(chr(9), c.idx, 0, list_position(m, ra) - 1, 0, array_to_string(m, ','))
from ichanged c join isite s on c.idx = s.idx and c.sample_id is not distinct from s.sample_id"""
)
