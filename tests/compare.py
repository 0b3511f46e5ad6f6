"""Order-insensitive comparison of a Spark result with a DuckDB one."""

from decimal import Decimal

import numpy as np


def plain(v):
    if v is None or isinstance(v, (str, bool, bytes)):
        return v
    if isinstance(v, (float, np.floating)):
        return None if v != v else round(float(v), 9)
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return [plain(x) for x in v]
    return str(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def duck_rows(relation):
    names = sorted(relation.columns)
    at = [relation.columns.index(c) for c in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
