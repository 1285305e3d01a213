"""Node rows for hand-built trees."""

from pyspark.sql import types as T

VEC = T.ArrayType(T.DoubleType())
RESIDUALS = T.ArrayType(T.StructType([T.StructField("audit", T.StringType()), T.StructField("hash", T.StringType())]))
S, B, I, L = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType()
STRINGS = T.ArrayType(S)
SCHEMA = T.StructType(
    [
        T.StructField(n, t)
        for n, t in [
            ("key", S), ("kind", S), ("name", S), ("path", S), ("ord", L), ("parent_key", S), ("depth", I), ("identity", VEC), ("leaf", VEC), ("patterns", STRINGS), ("companion", S), ("util", B),
            ("helper", B), ("exported", B), ("pure", B), ("bound", S), ("residuals", RESIDUALS), ("description", S), ("calls", STRINGS), ("returns_type", S), ("param_names", STRINGS),
            ("param_types", STRINGS), ("documented_params", I), ("has_return_doc", B),
        ]
    ]
)
DEFAULTS = {
    "patterns": [], "companion": None, "util": False, "helper": False, "exported": True, "pure": True, "bound": None, "residuals": [], "description": "told", "calls": [],
    "returns_type": "void", "param_names": [], "param_types": [], "documented_params": 0, "has_return_doc": False,
}


def vec(x):
    return [float(v) for v in x]


class Tree:
    """Rows under dir:src, in the order in which they are added."""

    def __init__(self):
        self.rows = []

    def add(self, kind, path, name=None, leaf=(), identity=None, parent=None, depth=0, **extra):
        prefix = {"function": "func", "type": "type", "file": "file", "directory": "dir", "pattern": "pattern"}[kind]
        key = f"{prefix}:{path}:{name}" if kind in ("function", "type") else f"{prefix}:{path}"
        identity = leaf if identity is None else identity
        row = DEFAULTS | extra | {"key": key, "kind": kind, "name": name or path.split("/")[-1], "path": path, "ord": len(self.rows), "parent_key": parent, "depth": depth, "identity": vec(identity), "leaf": vec(leaf)}
        self.rows.append(tuple(row[f.name] for f in SCHEMA.fields))
        return key

    def dir(self, path, leaf, identity=None, **extra):
        parent = "dir:" + path.rsplit("/", 1)[0] if "/" in path else None
        return self.add("directory", path, None, leaf, identity, parent, path.count("/"), **extra)

    def file(self, path, leaf, identity=None, **extra):
        return self.add("file", path, None, leaf, identity, "dir:" + path.rsplit("/", 1)[0], path.count("/"), **extra)

    def fn(self, path, name, leaf, kind="function", **extra):
        return self.add(kind, path, name, leaf, None, f"file:{path}", path.count("/") + 1, **extra)

    def frame(self, spark):
        return spark.createDataFrame(self.rows, SCHEMA)
