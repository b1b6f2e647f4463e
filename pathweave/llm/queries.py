"""The operators over the given tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathweave.llm import alignment, exact_dedup, merkle, mixing, packing, pii, prefix_join, quality, rules, secrets, simhash, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The file of the tokenizer that packing counts with; every executor has it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_bpe() -> tuple[str, str]:
    """The byte-level tokenizer of alignment: its ranks (the vocabulary of byte_bpe_50k.json) and its pattern of words."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def piece_bpe() -> str:
    """The piece model of alignment."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(_table(spark, sf_dir, "documents"), byte_bpe(), piece_bpe())


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proof_report(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_url_filter": op2_url_filter,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_secrets": op5_secrets,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op8_pii": op8_pii,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_prefix_join": op11_prefix_join,
    "op12_alignment": op12_alignment,
    "op13_merkle": op13_merkle,
}



def _field(sql: str) -> str:
    return f"coalesce(strlen({sql}) || ':' || {sql}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id::varchar", "source", "lang", "n_chars::varchar", text))) + ")"


def _up(name: str, source: str) -> str:
    """All nodes of trees, level by level."""
    return f"""{name}(tree, level, pos, digest) as (
          select tree, 0, pos, digest from {source} union all
          select tree, level + 1, pos // 8, sha256(string_agg(digest, '' order by pos))
          from (select *, count(*) over (partition by tree) as n from {name}) where n > 1 group by tree, level, pos // 8)"""


def _way(name: str, source: str, nodes: str) -> str:
    """From each leaf to its root: siblings so far, and what folding gives."""
    return f"""{name}(r, tree, level, pos, siblings, folded) as (
          select r, tree, 0, pos, siblings, folded from {source} union all
          select p.r, p.tree, p.level + 1, p.pos // 8, p.siblings || coalesce(string_agg(case when n.pos <> p.pos then n.digest end, '' order by n.pos), ''),
                 sha256(string_agg(case when n.pos = p.pos then p.folded else n.digest end, '' order by n.pos))
          from {name} p join {nodes} n on n.tree = p.tree and n.level = p.level and n.pos // 8 = p.pos // 8
          where p.level < (select max(level) from {nodes} m where m.tree = p.tree)
          group by p.r, p.tree, p.level, p.pos, p.siblings, p.folded)"""


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op7_mixing": r"""
        with recursive docs as (
          select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
        summed as (
          select source, sum(size) as source_size, sum(size * (2048 + least(size, 2048))) as heavy from docs group by source),
        sources as (
          select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from summed),
        levels(i, level) as (
          select 0, sum(source_size)::bigint / sum(weight)::bigint from sources
          union all
          select i + 1, ((select sum(source_size) from sources)
                         - sum(case when 3 * source_size < level * weight then 3 * source_size else 0 end))::bigint
                        / sum(case when 3 * source_size < level * weight then 0 else weight end)::bigint
          from levels, sources where i < 40 group by i),
        planned as (
          select source, source_size::bigint as source_size, heavy::bigint as heavy, least(level * weight, (3 * source_size)::double) as target
          from sources, (select max(level) as level from levels)),
        wholes as (
          select *, case when source_size > 0 then floor(target / source_size)::int else 0 end as whole from planned),
        drawn as (
          select d.doc_id, d.size, w.*, (('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u,
                 case when w.source_size > 0 then (target / source_size - whole) * (2048 + least(size, 2048)) * source_size / heavy end as p
          from docs d join wholes w on d.source is not distinct from w.source),
        ranked as (
          select *, case when target - whole * source_size > 0 and size > 0 then u / (1 - u) * greatest(1 - p, 0.0) / p end as rank from drawn),
        added as (
          select *, rank is not null and coalesce(sum(size) over (partition by source, rank is null order by rank, doc_id nulls first
                        rows between unbounded preceding and 1 preceding), 0)::double + size / 2.0 <= target - whole * source_size as more
          from ranked)
        select doc_id, size::bigint as size, source_size, target, (size * (whole + more::int))::bigint as taken from added""",
    "op9_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id = max(doc_id) over same as kept, sha256(t) as text_sha256
        from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
              from documents)
        window same as (partition by t)""",
    "op13_merkle": f"""
        with recursive crc(i, k, c) as (
          select i, 0, i from range(256) g(i) union all
          select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc where k < 8),
        tab as (select list(c order by i) as t from crc where k = 8),
        docs as (
          select doc_id, coalesce('=' || lang, '') as tree, {_leaf("text")} as leaf, {_leaf(_LOW)} as low,
                 xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
                                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 as change
          from documents, tab),
        leaves as (
          select row_number() over () as r, doc_id, tree, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos,
                 leaf as digest, '' as siblings, case when change then low else leaf end as folded from docs),
        {_up("nodes", "leaves")},
        {_way("ways", "leaves", "nodes")},
        subroots as (select n.tree as name, 'all' as tree, row_number() over (order by n.tree) - 1 as pos, n.digest
                     from nodes n where n.level = (select max(level) from nodes m where m.tree = n.tree)),
        {_up("tops", "subroots")},
        inner_ends as (select w.r, 'all' as tree, s.pos, w.siblings, w.folded from ways w join subroots s on s.name = w.tree
                       where w.level = (select max(level) from nodes m where m.tree = w.tree)),
        {_way("over", "inner_ends", "tops")},
        root as (select digest from tops where level = (select max(level) from tops))
        select l.doc_id, l.digest as leaf, s.digest as subroot, root.digest as root, sha256(o.siblings) as proof_sha256, o.folded as folded_root,
               o.folded = root.digest as verified
        from leaves l join subroots s on s.name = l.tree join over o on o.r = l.r, root
        where o.level = (select max(level) from tops)""",
}
