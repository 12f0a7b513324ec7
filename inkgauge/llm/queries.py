"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import settle, table
from . import cutoffs, leakage, overlap, packing, percentiles, repetition, splits

FEATURES = ["laplacianStdev", "brightnessAvg"]


def p1_found(spark, d):
    return overlap.image_pairs(table(spark, d, "features")).select("image_id_a", "image_id_b")


def p1_report(spark, d):
    return overlap.report(table(spark, d, "features"))


def p1_pairs(spark, d):
    """The number of overlapping pairs per split and source of the evaluation image."""
    return overlap.pair_counts(table(spark, d, "features"))


def _sketches(spark, d):
    f = table(spark, d, "features").select(F.lower(F.trim("preset")).alias("preset"), "load_id", *FEATURES)
    return settle(percentiles.sketches(f, ["preset", "load_id"], FEATURES))


def p2_percentiles(spark, d):
    """Per load, and (load_id null) for all loads together from the loads' sketches."""
    loads = _sketches(spark, d)
    whole = percentiles.merged(loads.drop("load_id"), ["preset", "feature"]).withColumn("load_id", F.lit(None).cast("int"))
    return percentiles.percentiles(loads.unionByName(whole)).select("preset", "load_id", "feature", "n", "q", "value", "rank_error")


def p3_found(spark, d):
    return cutoffs.kept_rows(table(spark, d, "results"), table(spark, d, "keep_targets")).select("result_id")


def p3_cutoffs(spark, d):
    taken = settle(cutoffs.counting_rows(table(spark, d, "results")))
    return cutoffs.cutoffs(taken, table(spark, d, "keep_targets"))


def p4_found(spark, d):
    return splits.found(table(spark, d, "features"))


def p4_balance(spark, d):
    return splits.balance(splits.assign(table(spark, d, "features"), table(spark, d, "split_shares")))


def p4_assign(spark, d):
    return splits.assign(table(spark, d, "features"), table(spark, d, "split_shares"))


def p6_found(spark, d):
    return packing.cut_texts(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p6_fill(spark, d):
    return packing.fill(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p7_found(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_places(spark, d):
    """Every case with its longest verbatim match and where that begins in item and text, in words."""
    return leakage.places(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_clean(spark, d):
    return leakage.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "source")


def p8_found(spark, d):
    return repetition.found(table(spark, d, "documents"))


def p8_hosts(spark, d):
    return repetition.hosts(repetition.measure(table(spark, d, "documents")))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_pairs, p2_percentiles, p3_found, p3_cutoffs, p4_found, p4_balance, p4_assign, p6_found, p6_fill, p7_found, p7_places, p7_clean, p8_found, p8_hosts)}

_FINITE = " and ".join(f'"{c}" is not null and isfinite("{c}")' for c in overlap.VALUES)
_COLS = ", ".join(f'"{c}"' for c in overlap.VALUES)
_NEAR = " and ".join(f'abs(t."{c}" - e."{c}") <= 0.005 * greatest(abs(t."{c}"), abs(e."{c}"))' for c in overlap.MEASURES)
_PAIRS = f"""
r as (select distinct image_id, lower(trim(split)) as split, {_COLS} from features where image_id is not null and {_FINITE}),
pairs as (select distinct t.image_id as t_id, e.image_id as e_id from r t join r e on t.width = e.width and t.height = e.height
  where t.split = 'train' and e.split in ('validation', 'test') and t.image_id <> e.image_id and {_NEAR})"""
_TAKEN = """
counting as (select result_id, lower(trim(source)) as source, preset, score,
  row_number() over (partition by image_id, case when image_id is null then result_id end order by analyzed_at desc nulls last, result_id desc) as no
  from results where score >= 0 and score <= 1 and not isnan(score)),
taken as (select * from counting where no = 1),
ranked as (select *, count(*) over (partition by source, preset) as n, count(*) over (partition by source, preset order by score desc) as upto from taken where source is not null and preset is not null),
wanted as (select lower(trim(source)) as source, preset, max(keep_percent) as keep_percent from keep_targets group by all),
cut as (select r.source, r.preset, keep_percent, any_value(n) as n, max(score) as cutoff from ranked r join wanted w on r.source = w.source and r.preset = w.preset
  where upto * 100 >= keep_percent * n group by all)"""
_PATHS = rf"""
below as (select distinct image_id, regexp_replace(lower(replace(path, '%20', ' ')), '^.*?[/\\](very-good|good|very-bad|bad|unsorted)[/\\]', '') as p from features where image_id is not null),
named as (select distinct image_id,
  nullif(regexp_extract('/' || p, '[^a-z]({splits.KINDS})[^a-z0-9]+([a-z0-9]{{6}})([^a-z0-9]|$)', 2), '') as paper,
  try_cast(nullif(regexp_extract('/' || regexp_replace('/' || p, '([^a-z])({splits.KINDS})[^a-z0-9]+[a-z0-9]{{6}}([^a-z0-9]|$)', '\1 \3'), '[^a-z]c-?0*([0-9]+)', 1), '') as bigint) as who from below)"""

SQL = {
    "p1_found": f"with {_PAIRS} select distinct least(t_id, e_id) as image_id_a, greatest(t_id, e_id) as image_id_b from pairs",
    "p1_report": f"""with {_PAIRS}, owners as (select distinct image_id, lower(trim(split)) as split, lower(trim(source)) as source from features where lower(trim(split)) in ('validation', 'test') and image_id is not null)
        select split, source, count(*) as images, sum((image_id in (select e_id from pairs))::int)::bigint as overlapping from owners group by all""",
    "p1_pairs": f"""with {_PAIRS}, owners as (select distinct image_id, lower(trim(split)) as split, lower(trim(source)) as source from features where lower(trim(split)) in ('validation', 'test') and image_id is not null)
        select split, source, count(distinct least(t_id, e_id) || '-' || greatest(t_id, e_id)) as pairs from owners left join pairs on e_id = image_id group by all""",
    "p3_found": f"with {_TAKEN} select result_id from taken t join cut c on t.source = c.source and t.preset = c.preset where t.score >= c.cutoff",
    "p3_cutoffs": f"with {_TAKEN} select c.source, c.preset, c.keep_percent, c.n, c.cutoff, (select count(*) from taken t where t.source = c.source and t.preset = c.preset and t.score >= c.cutoff) as kept from cut c",
    "p4_found": f"""with recursive {_PATHS},
        links as (select distinct a.who as a, b.who as b from named a join named b on a.paper = b.paper where a.who is not null and b.who is not null
          union select distinct a.who, b.who from named a join named b on a.image_id = b.image_id where a.who is not null and b.who is not null),
        reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
        whose as (select a as who, min(b) as group_no from reach group by a),
        papers as (select paper, min(group_no) as group_no from named join whose using (who) where paper is not null group by paper)
        select image_id, min(coalesce(w.group_no, p.group_no)) as group_no from named n left join whose w on n.who = w.who left join papers p on n.paper = p.paper group by image_id""",
    "p6_found": "select limit_id, doc_id from pack_limits, documents where octet_length(encode(text)) > capacity_tokens",
    # Exact percentiles; the sketch equals them while rank_error is 0, as it is on tables of this size.
    "p2_percentiles": """with v as (select lower(trim(preset)) as preset, load_id, 'laplacianStdev' as feature, laplacianStdev as value from features
          union all select lower(trim(preset)), load_id, 'brightnessAvg', brightnessAvg from features),
        ok as (select * from v where value is not null and isfinite(value) and value >= 0),
        scoped as (select * from ok union all select preset, null, feature, value from ok),
        r as (select *, row_number() over (partition by preset, load_id, feature order by value) as no, count(*) over (partition by preset, load_id, feature) as n from scoped),
        q as (select unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::double[]) as q)
        select preset, load_id, feature, n, q, value, 0::bigint as rank_error from r join q on no = greatest(1, ceil(q * n - 1e-9)::bigint)""",
    "p8_found": r"""with t as (select doc_id, regexp_extract_all(lower(regexp_replace(text, '(^|\n)-[^\n]*', '\1', 'g')), '\p{L}+') as w from documents),
        x as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos, len(w) as n from t),
        g as (select *, string_agg(word, ' ') over (partition by doc_id order by pos rows between current row and 7 following) as gram from x),
        f as (select *, pos + 7 <= n and row_number() over (partition by doc_id, gram, pos + 7 <= n order by pos) > 1 as again from g),
        c as (select *, bool_or(again) over (partition by doc_id order by pos rows between 7 preceding and current row) as covered from f)
        select doc_id from c group by doc_id having count_if(covered) * 100 >= 30 * count(*)""",
}
