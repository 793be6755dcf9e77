"""JSON log lines: formatting, reading, selecting and reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayer.functions.labels import Match, all_match

MAP = "map<string,string>"


def format_log(
    timestamp: Column,
    severity: Column,
    message: Column,
    logger: Column,
    service: Column,
    team: Column,
    trace_id: Column,
    span_id: Column,
    extra: Column | None = None,
    error_type: Column | None = None,
    error_message: Column | None = None,
) -> Column:
    """One JSON line; trace ids only together, extras override, exception fields last.

    The fixed keys are one struct, written without building a map. Only a line whose extras repeat
    one of them is merged key by key.
    """
    fields = {
        "timestamp": timestamp,
        "severity": severity,
        "message": message,
        "logger": logger,
        "service.name": service,
        "lab.team": team,
        "trace_id": F.when(span_id.isNotNull(), trace_id),
        "span_id": F.when(trace_id.isNotNull(), span_id),
    }
    last = {}
    if error_type is not None:
        last = {"error.type": error_type, "error.message": error_message}

    def as_struct(named: dict[str, Column]) -> Column:
        return F.to_json(F.struct(*[c.alias(f"{n}") for n, c in named.items()]))

    def as_map(named: dict[str, Column]) -> Column:
        return F.create_map(*[x for n, c in named.items() for x in (F.lit(n), c)])

    if extra is None:
        return as_struct({**fields, **last})
    parts = [as_map(fields), extra, *([as_map(last)] if last else [])]
    merged = F.to_json(F.map_filter(F.map_concat(*parts), lambda _, x: x.isNotNull()))
    repeated = F.arrays_overlap(F.map_keys(extra), F.array(*[F.lit(n) for n in (*fields, *last)]))

    def inner(text: Column) -> Column:
        """The members of a JSON object, null for an empty one."""
        return F.nullif(F.substring(text, F.lit(2), F.length(text) - 2), F.lit(""))

    kept = F.map_filter(extra, lambda _, x: x.isNotNull())
    members = [inner(as_struct(fields)), inner(F.to_json(kept)), *([inner(as_struct(last))] if last else [])]
    joined = F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    return F.when(extra.isNotNull() & repeated, merged).otherwise(joined)


def parse_logs(lines: DataFrame, column: str = "line", promoted: Sequence[str] = ()) -> DataFrame:
    """Adds ``fields`` (all keys) and one column per promoted key, dots as underscores."""
    parsed = lines.withColumn("fields", F.from_json(column, MAP))
    return parsed.withColumns(
        {name.replace(".", "_"): F.try_element_at(F.col("fields"), F.lit(name)) for name in promoted}
    )


def read_fields(lines: DataFrame, names: Sequence[str], column: str = "line") -> DataFrame:
    """Adds ``fields`` as a struct of the named keys alone, where :func:`parse_logs` reads them all into a map."""
    shape = T.StructType([T.StructField(name, T.StringType()) for name in names])
    return lines.withColumn("fields", F.from_json(column, shape))


def select_lines(
    lines: DataFrame, labels: Sequence[Match] = (), contains: Sequence[str] = (), regex: str | None = None, column: str = "line"
) -> DataFrame:
    """Stream labels first, then the line: any of the substrings, and the regex anywhere."""
    out = lines.where(all_match(labels))
    if contains:
        hit = F.lit(False)
        for text in contains:
            hit = hit | F.col(column).contains(text)
        out = out.where(hit)
    return out.where(F.col(column).rlike(regex)) if regex else out


def field(name: str) -> Column:
    """A key's value from ``fields``, struct or map; '' where it is absent."""
    return F.coalesce(F.col("fields")[name], F.lit(""))


def line_format(template: str, names: Sequence[str]) -> Column:
    """A new line from fields; ``template`` holds one %s per name."""
    return F.format_string(template, *[field(n) for n in names])
