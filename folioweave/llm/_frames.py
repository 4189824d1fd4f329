"""Small DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Numbers that keys are hashed to, to tell those delivered again; so many rows are broadcast at most.
SLOTS = 1 << 20


def once(df: DataFrame, key: str, *cols, latest: str = "ingested_at") -> DataFrame:
    """One row a key: rows delivered again have the same content and a later `latest`.

    The first delivery stays. Null keys name no row and are left out. `cols` are (name, Column or None)
    pairs or names; all other columns go, so clashing extra columns do no harm.

    Keys alone are counted first; only rows whose key falls on the number of one that came again are shuffled with
    their content. As the numbers fill up with the input more rows are, and the result stays the same.
    """
    picked = [F.col(key).alias("k")]
    names = []
    for c in cols:
        n, x = (c, F.col(c)) if isinstance(c, str) else c
        names.append(n)
        picked.append(x.alias(f"v_{n}"))
    when = F.col(latest) if latest in df.columns else F.lit(None).cast("timestamp")
    slot = F.pmod(F.xxhash64("k"), F.lit(SLOTS)).cast("int")
    again = df.select(F.col(key).alias("k")).where("k is not null").groupBy("k").count().where("count > 1").select(slot.alias("slot")).distinct()
    d = df.select(*picked, when.alias("t")).where(F.col("k").isNotNull()).withColumn("slot", slot)
    alone = d.join(F.broadcast(again), "slot", "left_anti").select(F.col("k").alias(key), *[F.col(f"v_{n}").alias(n) for n in names])
    vals = F.struct(*[F.col(f"v_{n}").alias(n) for n in names])
    d = d.join(F.broadcast(again), "slot", "left_semi").groupBy("k").agg(F.min_by(vals, F.coalesce(F.col("t"), F.lit("9999-01-01").cast("timestamp"))).alias("v"))
    return alone.unionByName(d.select(F.col("k").alias(key), *[F.col("v")[n].alias(n) for n in names]))


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow of fn(columns as a dict of lists) -> dict of lists, batch by batch, empty batches left out."""
    from pyspark.sql.types import _parse_datatype_string

    out_schema = _parse_datatype_string(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        sch = to_arrow_schema(out_schema)
        for b in batches:
            if b.num_rows:
                got = fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
                yield pa.RecordBatch.from_pydict({f.name: pa.array(got[f.name], f.type) for f in sch}, schema=sch)

    return df.mapInArrow(run, schema)
