"""A universe with known truth from the part table: one entity a part, and noisy records of two further sources.

Expressions are plain SQL that other engines read too. Every part takes part; whether it has a copy in a source, and
how that is spoilt, follows from its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_WORD = "translate(substr(md5(cast(p_partkey as string)), {at}, 6), '0123456789abcdef', 'bakelimonuprstvy')"
WORD1, WORD2 = _WORD.format(at=1), _WORD.format(at=9)

COUNTRY = "case p_partkey % 3 when 0 then 'US' when 1 then 'India' else 'France' end"
CITY = (
    "case p_partkey % 3 when 0 then (case p_size % 4 when 0 then 'New York' when 1 then 'West Virginia' when 2 then 'Texas' else 'Florida' end)"
    " when 1 then (case p_size % 3 when 0 then 'Tamil Nadu' when 1 then 'Delhi' else 'Uttar Pradesh' end) else (case p_size % 3 when 0 then 'Paris' when 1 then 'Lyon' else 'Lille cc' end) end"
)
STREET = "case p_size % 4 when 0 then 'St' when 1 then 'Ave.' when 2 then 'Road' else 'Blvd' end"
NUMBER = "cast(100 + (p_partkey * 37) % 9000 as string)"
LEGAL = "case p_partkey % 5 when 0 then ' Inc.' when 1 then ' L.L.C.' when 2 then ' & Co' when 3 then ' Pvt Ltd' else '' end"
NAME = f"({WORD1} || ' ' || p_name || {LEGAL})"
ADDR = f"({NUMBER} || ' ' || {WORD2} || ' ' || {STREET} || ', ' || {CITY})"

NAME2 = (
    f"case (p_partkey * 13) % 6 when 0 then {NAME} when 1 then upper({WORD1} || ' ' || p_name) when 2 then p_name || ' ' || {WORD1} when 3 then replace({WORD1} || ' ' || p_name, 'k', 'c')"
    f" when 4 then 'www.' || {WORD1} || replace(p_name, ' ', '') || '.com' else 'M/s. ' || {WORD1} || ' & ' || p_name || ' Limited' end"
)
ADDR2 = f"case (p_partkey * 17) % 4 when 0 then {ADDR} when 1 then replace({ADDR}, 'Road', 'rd') when 2 then {WORD2} || ' ' || {STREET} || ', ' || {CITY} else 'N/A' end"

ENTITIES = f"select 'P' || cast(p_partkey as string) as id, {NAME} as name, {ADDR} as addr, {COUNTRY} as country from part"
RECORDS = (
    f"select 'A' || cast(p_partkey as string) as id, {NAME2} as name, {ADDR2} as addr, {COUNTRY} as country from part where (p_partkey * 31 + 7) % 10 < 8"
    f" union all select 'B' || cast(p_partkey as string), replace({NAME}, 'e', 'é'), 'Suite 005, ' || {ADDR}, {COUNTRY} from part where (p_partkey * 41 + 3) % 10 < 6"
    f" union all select 'U' || cast(p_partkey as string), {WORD1} || ' ' || p_name || ' trading', cast(102 + (p_partkey * 37) % 9000 as string) || ' ' || {WORD2} || ' ' || {STREET} || ', ' || {CITY}, {COUNTRY}"
    " from part where (p_partkey * 53 + 1) % 10 < 3"
)
TRUTH = (
    "select 'P' || cast(p_partkey as string) as s1, 'A' || cast(p_partkey as string) as r from part where (p_partkey * 31 + 7) % 10 < 8"
    " union all select 'P' || cast(p_partkey as string), 'B' || cast(p_partkey as string) from part where (p_partkey * 41 + 3) % 10 < 6"
)


def universe(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities and records (id, name, addr, country), and the true pairs (s1, r)."""
    # one small file is one task, but what is made of it is far larger
    part = spark.read.parquet(f"{sf_dir}/part.parquet").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return tuple(spark.sql(text.replace("from part", "from {part}"), part=part) for text in (ENTITIES, RECORDS, TRUTH))
