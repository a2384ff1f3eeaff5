"""Box, image and reward tables derived from the given tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.sources.tables import register_views

CTES = {
    "fx_images": """SELECT o_orderkey AS image_id,
        concat('/data/SDG/', gen, '/', split, '/', split, '_', lpad(cast(o_orderkey AS string), 6, '0'), '.png') AS filepath,
        gen, split, concat('caption ', o_orderpriority, ' ', o_orderstatus) AS caption
      FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'sana' WHEN 1 THEN 'flux2' WHEN 2 THEN 'zimage' ELSE 'longcat' END AS gen,
              CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM orders) o""",
    "fx_base": """SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY ln, pk, sk, q, px) - 1 AS k, ln, pk, sk, rf, ls,
        pk * 37 % 760 AS x0, sk * 53 % 760 AS y0, pk * 37 % 760 + 20 + q * 3 AS x1, sk * 53 % 760 + 25 + pk * 7 % 150 AS y1
      FROM (SELECT l_orderkey AS image_id, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_returnflag AS rf, l_linestatus AS ls,
              cast(floor(l_quantity) AS bigint) AS q, l_extendedprice AS px FROM lineitem) l""",
    "fx_gt": """SELECT image_id, k AS gt_idx, x0, y0, x1, y1,
        CASE rf WHEN 'A' THEN 'artifact' WHEN 'R' THEN 'misalignment' ELSE 'both' END AS label, 1 + pk * 13 % 100 AS importance
      FROM fx_base WHERE image_id % 9 <> 0""",
    "fx_pred": """SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY k, fp) - 1 AS pred_idx, x0, y0, x1, y1, label, importance
      FROM (SELECT image_id, k, 0 AS fp, greatest(0, x0 + sk * ln % 121 - 60) AS x0, greatest(0, y0 + pk * ln % 61 - 30) AS y0,
              greatest(0, x0 + sk * ln % 121 - 60) + x1 - x0 AS x1, greatest(0, y0 + pk * ln % 61 - 30) + y1 - y0 AS y1,
              CASE WHEN pk % 5 = 0 THEN 'artifact' WHEN rf = 'R' THEN 'misalignment' ELSE 'artifact' END AS label, 1 + pk * 29 % 100 AS importance
            FROM fx_base WHERE (pk + ln) % 7 <> 0
            UNION ALL SELECT image_id, k, 1, 10, 10, 210, 160, 'artifact', 50 FROM fx_base WHERE k = 0 AND image_id % 6 = 0) p
      WHERE image_id % 10 <> 0""",
    "fx_rewards": """SELECT event_id AS sample_id, user_id AS unique_id, 'value' AS reward_name, value / 100e0 AS reward FROM events
      UNION ALL SELECT event_id, user_id, 'key', event_id * 17 % 23 / 23e0 FROM events
      UNION ALL SELECT event_id, user_id, 'type', length(event_type) * 1e0 FROM events""",
}
NEEDS = {"fx_images": [], "fx_base": [], "fx_gt": ["fx_base"], "fx_pred": ["fx_base"], "fx_rewards": []}


def with_clause(*names: str) -> str:
    """WITH of the named tables and what they need."""
    found: list[str] = []
    for n in names:
        found += [x for x in (*NEEDS[n], n) if x not in found]
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in found)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register_views(spark, sf_dir, {"fx_images": ["orders"], "fx_rewards": ["events"]}.get(name, ["lineitem"]))
    return spark.sql(f"{with_clause(name)} SELECT * FROM {name}")
