"""Reports over the result and reject tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT_COLUMNS = ("aggregate_id", "window_start", "window_end", "ticket_count", "total_amount_gs", "duplicates_discarded", "pane_index", "pane_timing", "panes_recibidos")
REJECT_COLUMNS = ("motivo", "detalle", "event_id", "event_time", "rechazado_en")


def result_rows(results: DataFrame, store_id: str | None = None) -> DataFrame:
    """Results in order of window and store, of one store if asked."""
    chosen = results if store_id is None else results.where(F.col("store_id") == store_id)
    return chosen.orderBy("window_start", "store_id")


def format_table(rows: DataFrame, columns: tuple[str, ...], limit: int = 10_000) -> str:
    """A Markdown table of at most ``limit`` rows and the number of rows left out; "(sin filas)" where there are none.

    Cells are padded by Spark to the widest value of their column, which one aggregate finds over all rows.
    """
    text = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    sizes = text.agg(F.count("*").alias("n"), *[F.coalesce(F.max(F.length(c)), F.lit(0)).alias(c) for c in columns]).first()
    if not sizes["n"]:
        return "(sin filas)"
    wide = {c: max(sizes[c], len(c)) for c in columns}
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.rpad(c, wide[c], " ") for c in columns]), F.lit(" |"))
    body = [r[0] for r in text.select(cells).limit(limit).collect()]
    head = ["| " + " | ".join(f"{c:<{wide[c]}}" for c in columns) + " |", "|" + "|".join("-" * (wide[c] + 2) for c in columns) + "|"]
    rest = sizes["n"] - len(body)
    return "\n".join(head + body + [f"({rest} filas más)"] * (rest > 0))


def summary(results: DataFrame, rejects: DataFrame) -> dict:
    row = results.agg(F.count("*"), F.coalesce(F.sum("panes_recibidos"), F.lit(0))).first()
    counts = {r["motivo"]: r["n"] for r in rejects.groupBy("motivo").agg(F.count("*").alias("n")).orderBy("motivo").collect()}
    return {"filas_ventas_por_ventana": row[0], "panes_aplicados_acumulados": row[1], "rechazos_por_motivo": counts}


def report(results: DataFrame, rejects: DataFrame) -> str:
    """Three sections: results, rejects and a summary."""
    return "\n".join(
        [
            "== ventas_por_ventana ==",
            format_table(result_rows(results), RESULT_COLUMNS),
            "\n== rechazos (DLQ) ==",
            format_table(rejects.orderBy(*[c for c in ("batch", "partition", "arrival", "rechazado_en", "motivo") if c in rejects.columns]), REJECT_COLUMNS),
            "\n== resumen ==",
            json.dumps(summary(results, rejects), ensure_ascii=False, indent=2),
        ]
    )


def partition_skew(records: DataFrame) -> DataFrame:
    """Messages of each source partition and key, and their share in hundredths of a percent. The total is a scalar subquery."""
    counts = records.groupBy("partition", "key").agg(F.count("*").alias("n"))
    shared = counts.withColumn("total", records.agg(F.count("*")).scalar())
    return shared.select("partition", "key", "n", F.expr("(n * 10000) div total").alias("share_bp"))
