"""Layer views over the test tables, the same text for Spark and DuckDB.

The views are SQL that both engines run unchanged, so an operator's input is
identical on both sides of a comparison. Measured values are whole numbers or
multiples of 1/1024, so sums are exact in any order. Views build on each other
by name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Tables with long texts or vectors, and their keys.
HEAVY_ROWS = {"documents": "doc_id", "embeddings": "vec_id"}

VIEWS = {
    "points": """
        SELECT 'b1' AS build, CAST(user_id % 7 + 1 AS INT) AS chr_id, CAST(event_id * 20 AS BIGINT) AS pos,
               event_id, event_type, CAST(round(value * 100) AS DOUBLE) AS value
        FROM events""",
    "intervals_a": """
        SELECT 'b1' AS build, CAST(l_linenumber AS INT) AS chr_id,
               CAST(l_partkey * 97 + l_suppkey * 13 AS BIGINT) AS start_pos,
               CAST(l_partkey * 97 + l_suppkey * 13 + CAST(l_quantity AS INT) * 10 AS BIGINT) AS end_pos,
               CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand,
               l_returnflag AS klass, CAST(floor(l_extendedprice) AS DOUBLE) AS score,
               CAST(round(l_discount * 100) AS DOUBLE) AS rate, l_orderkey AS feature_id
        FROM lineitem""",
    "intervals_b": """
        SELECT 'b1' AS build, CAST(o_custkey % 7 + 1 AS INT) AS chr_id,
               CAST(o_orderkey * 13 AS BIGINT) AS start_pos,
               CAST(o_orderkey * 13 + 200 + o_custkey % 300 AS BIGINT) AS end_pos,
               o_orderpriority AS klass, CAST(floor(o_totalprice) AS DOUBLE) AS score, o_orderkey AS feature_id
        FROM orders""",
    "domains": """
        SELECT 'b1' AS build, CAST(s_suppkey % 7 + 1 AS INT) AS chr_id,
               CAST(s_suppkey * 17000 AS BIGINT) AS start_pos,
               CAST(s_suppkey * 17000 + 2000 + (s_suppkey % 9) * 24000 AS BIGINT) AS end_pos,
               s_suppkey AS domain_id, CAST(floor(s_acctbal) AS DOUBLE) AS score
        FROM supplier""",
    "regions": """
        SELECT CAST(chr_id AS BIGINT) * 1000000 + tile AS region_id, 'b1' AS build, chr_id,
               tile * 5000 AS start_pos, tile * 5000 + 5000 AS end_pos
        FROM (SELECT DISTINCT chr_id, CAST(floor(start_pos / 5000) AS BIGINT) AS tile FROM intervals_b)""",
    "windows": """
        SELECT 'b1' AS build, a.chr_id, a.start_pos, a.start_pos + 1000 AS end_pos,
               a.n_a, a.curvature, a.stacking, a.rate, b.n_b, b.mean_b
        FROM (SELECT chr_id, CAST(floor(start_pos / 1000) * 1000 AS BIGINT) AS start_pos, count(*) AS n_a,
                     avg(score) AS curvature, avg(CASE WHEN klass = 'R' THEN score END) AS stacking, avg(rate) AS rate
              FROM intervals_a GROUP BY 1, 2) a
        LEFT JOIN (SELECT chr_id, CAST(floor(start_pos / 1000) * 1000 AS BIGINT) AS start_pos, count(*) AS n_b,
                          avg(score) AS mean_b
                   FROM intervals_b GROUP BY 1, 2) b
        ON a.chr_id = b.chr_id AND a.start_pos = b.start_pos""",
    "nonb": """
        SELECT 'b1' AS build, chr_id, CAST(floor(pos / 1000) * 1000 AS BIGINT) AS start_pos,
               sum(value) AS nonb_density
        FROM points GROUP BY 2, 3""",
    "genes": """
        SELECT 'b1' AS build, CAST(p_partkey % 7 + 1 AS INT) AS chr_id, CAST(p_partkey * 950 AS BIGINT) AS start_pos,
               CAST(p_partkey * 950 + p_size * 100 AS BIGINT) AS end_pos,
               CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
               concat('ENSG', CAST(p_partkey AS STRING), '.', CAST(p_size % 5 AS STRING)) AS gene_id,
               upper(concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS STRING))) AS symbol,
               p_brand AS klass, p_type AS gene_type, CAST(floor(p_retailprice) AS DOUBLE) AS price, p_size AS size
        FROM part""",
    "gene_tpm": """
        SELECT concat('ENSG', CAST(l_partkey AS STRING)) AS gene_id, concat('t', CAST(l_linenumber AS STRING)) AS tissue,
               CAST(sum(CAST(l_quantity AS BIGINT)) % 97 AS DOUBLE) / 4 AS tpm
        FROM lineitem GROUP BY 1, 2""",
    "probes": """
        SELECT concat('cg', CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS STRING)) AS probe_id, 'b1' AS build,
               CAST(CAST(floor(c_custkey / 5) AS BIGINT) % 7 + 1 AS INT) AS chr_id,
               CAST(floor(c_custkey / 5) AS BIGINT) * 700 AS pos,
               CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'epic_v1'
                    WHEN c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') THEN 'epic_v2' ELSE 'hm450' END AS platform,
               c_custkey AS row_id, CAST(floor(c_acctbal) AS DOUBLE) AS coef
        FROM customer""",
    "betas": """
        SELECT concat('cg', CAST(user_id % 200 AS STRING)) AS probe_id, CAST(event_id AS BIGINT) AS event_id,
               concat('s', CAST(event_id % 6 AS STRING)) AS sample, event_type AS cell_type,
               CAST(user_id % 7 + 1 AS INT) AS chr_id, CAST(event_id * 20 AS BIGINT) AS pos, 'b1' AS build,
               CAST(floor(value / (value + 20.0) * 1024) AS DOUBLE) / 1024 AS beta
        FROM events""",
    "sequences": """
        SELECT doc_id AS seq_id,
               translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz',
                         'ACGTACGTACGTACGTACGTACGTAC') AS sequence, lang, source
        FROM documents""",
    "variants": """
        SELECT seq_id AS variant_id, seq_id, CAST(seq_id % 50 + 20 AS INT) AS pos,
               substring(sequence, CAST(seq_id % 50 + 21 AS INT), 1) AS ref,
               translate(substring(sequence, CAST(seq_id % 50 + 21 AS INT), 1), 'ACGT', 'CGTA') AS alt
        FROM sequences WHERE length(sequence) > 80""",
    "alleles": """
        SELECT CAST(p_partkey AS BIGINT) AS allele_id, concat('A', CAST(p_partkey AS STRING)) AS allele_name,
               p_type AS locus, substring(p_name, 1, 1) AS allele_group, p_brand AS protein,
               CASE WHEN p_size % 5 = 0 THEN CASE WHEN p_size % 3 = 0 THEN 'L' WHEN p_size % 3 = 1 THEN 'Q' ELSE 'N' END
               END AS suffix,
               p_partkey % 4 <> 0 AS has_genomic, CAST(floor(p_retailprice) AS DOUBLE) AS m_price, CAST(p_size AS DOUBLE) AS m_size,
               CAST((p_partkey * 37) % 101 AS DOUBLE) AS m_mod
        FROM part""",
}


def _spark_text(sql: str) -> str:
    """The few spellings that differ: Spark has no 'g' flag, which is its default."""
    return sql.replace(", '', 'g')", ", '')").replace("|| ''", "")


def _needed(names: list[str]) -> list[str]:
    """Views in dependency order."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for other in VIEWS:
            if other != name and re.search(rf"\b(FROM|JOIN)\s+{other}\b", VIEWS[name]):
                visit(other)
        done.append(name)

    for name in names:
        visit(name)
    return done


class Tables:
    """Base tables and layer views of one data directory, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._built: dict[str, DataFrame] = {}

    def _read(self, name: str) -> DataFrame:
        """A base table. Tables whose rows are costly to process are dealt out anew, so that work does not follow file sizes."""
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in HEAVY_ROWS:
            return table
        parts = max(2 * self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return table.repartition(parts, HEAVY_ROWS[name])

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        if name not in self._built:
            if name in VIEWS:
                text = _spark_text(VIEWS[name])
                uses = [n for n in (*VIEWS, *BASE_TABLES) if re.search(rf"\b(FROM|JOIN)\s+{n}\b", VIEWS[name])]
                named = re.sub(
                    rf"\b(FROM|JOIN)\s+({'|'.join(uses)})\b", lambda m: f"{m.group(1)} {{{m.group(2)}}}", text
                )
                self._built[name] = self.spark.sql(named, **{n: getattr(self, n) for n in uses})
            elif name in BASE_TABLES:
                self._built[name] = self._read(name)
            else:
                raise AttributeError(name)
        return self._built[name]


def oracle(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """DuckDB text: the named views (with what they build on), extra CTEs, then the body."""
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in _needed(list(views))]
    parts += [f"{n} AS ({text.strip()})" for n, text in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()
