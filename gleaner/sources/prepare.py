"""Table preparation: column names, infinities, empty columns and rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.columns import finite


def unique_names(names: list[str]) -> list[str]:
    """Trimmed names; blanks become column_{i}, repeats get _2, _3, ... and never meet an existing name."""
    plain = [str(n).strip() or f"column_{i}" for i, n in enumerate(names, start=1)]
    taken = set(plain)
    seen: dict[str, int] = {}
    result = []
    for name in plain:
        seen[name] = seen.get(name, 0) + 1
        if seen[name] > 1:
            while f"{name}_{seen[name]}" in taken:
                seen[name] += 1
            taken.add(f"{name}_{seen[name]}")
            name = f"{name}_{seen[name]}"
        result.append(name)
    return result


def prepare_table(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Unique names, infinities and NaN as null, columns without values dropped; with warnings. All rows stay."""
    warnings = []
    frame = finite(df.toDF(*unique_names(df.columns)))
    counts = frame.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(frame.columns)]).first()
    empty = [c for i, c in enumerate(frame.columns) if counts[f"n{i}"] == 0]
    if empty:
        frame = frame.drop(*empty)
        warnings.append(f"Dropped {len(empty)} empty column(s).")
    if not frame.columns:
        raise ValueError("The table contains no usable rows.")
    return frame, warnings
