"""Plain-Python versions of the operators, for comparison on small inputs."""

import json
from collections import defaultdict


def json_type(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    return {int: "whole", float: "fractional", str: "string", list: "array", dict: "object"}[type(v)]


def text(v):
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def schema_changes(rows, share=0.8):
    """rows: (series_no, file_no, file_id, record_key, payload)."""
    files = defaultdict(dict)
    for s, no, f, key, payload in set(rows):
        files[(s, no, f)][key] = json.loads(payload) if payload else {}
    out = []
    for s in sorted({k[0] for k in files}):
        line = sorted(k for k in files if k[0] == s)
        for a, b in zip(line, line[1:]):
            x, y = files[a], files[b]
            fields = lambda z: {k for o in z.values() for k in o}
            gone, come = fields(x) - fields(y), fields(y) - fields(x)
            pairs = []
            for g in gone:
                for c in come:
                    seen = [(x[k].get(g), y[k].get(c)) for k in x if k in y]
                    seen = [(text(p), text(q)) if p is not None and q is not None else (0, 1) for p, q in seen if p is not None or q is not None]
                    same = sum(p == q for p, q in seen)
                    if seen and same >= share * len(seen):
                        pairs.append((same / len(seen), len(seen), g, c))
            pairs.sort(key=lambda p: (-p[0], -p[1], p[2], p[3]))
            used = set()
            for _, _, g, c in pairs:
                if ("g", g) not in used and ("c", c) not in used:
                    used |= {("g", g), ("c", c)}
                    out.append((b[2], "renamed", g, c))
            out += [(b[2], "removed", g, "") for g in gone if ("g", g) not in used]
            out += [(b[2], "added", c, "") for c in come if ("c", c) not in used]
            for f in fields(x) & fields(y):
                p = {json_type(o.get(f)) for o in x.values()} - {None}
                q = {json_type(o.get(f)) for o in y.values()} - {None}
                lattice = lambda t: next(iter(t)) if len(t) == 1 else "fractional" if t == {"whole", "fractional"} else "string"
                if p and q and lattice(p) != lattice(q):
                    out.append((b[2], "retyped", f, ""))
    return sorted(out)
