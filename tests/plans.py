"""What stands above a scan in a physical plan."""

import re


def text_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def above(df, needle):
    """For each scan whose line holds ``needle``: the operators above it, nearest first."""
    path, out = [], []
    for line in text_of(df).split("\n"):
        m = re.match(r"[ :+\-*()0-9]*", line)
        depth, name = m.end(), line[m.end() :]
        if not name:
            continue
        path = [x for x in path if x[0] < depth]
        if "Scan" in name and needle in name:
            out.append([n for _, n in reversed(path)])
        path.append((depth, name))
    return out
