"""Plans as data: JSON operator trees interpreted as DataFrames.

Columns are known by (relation, attribute). Inside a plan they are named ``relation|attribute`` so that the same name in
two relations doesn't clash; sizing and placement keys of the plan are read over, as Spark does both itself.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.monoids import fold
from ..sources.catalog import TYPES, Catalog

# Operator tags of plan files, by what they come to here.
SAME = ("cpu-to-gpu", "gpu-to-cpu", "block-to-tuples", "unpack", "tuples-to-block", "pack", "mem-move-device", "mem-move-local-to")
JOINS = {"hashjoin-chained": None, "partitioned-hashjoin-chained": "shuffle_hash", "out-of-gpu-join": "merge"}
COMPARE = {"eq": lambda a, b: a == b, "neq": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b}
BINARY = COMPARE | {"and": lambda a, b: a & b, "or": lambda a, b: a | b, "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "multiply": lambda a, b: a * b, "mod": scalar.mod}
BINARY |= {"xor": scalar.xor, "max": scalar.largest, "min": scalar.smallest}
SHIFTS = {"shl": scalar.shift_left, "shr": scalar.shift_right, "shr_logical": scalar.shift_right_logical}
CONSTANTS = {"bool": "boolean", "int": "int", "int64": "bigint", "float": "double", "string": "string", "dstring": "string"}


class PlanError(ValueError):
    pass


def label(attr: dict) -> str:
    return f"{attr.get('relName', '')}|{attr['attrName']}"


class Interpreter:
    """Plans against a catalog. ``params`` are the values of placeholders."""

    def __init__(self, catalog: Catalog, params: list | None = None):
        self.catalog, self.params, self.shared, self.bound, self.filters = catalog, params or [], {}, {}, {}

    def run(self, plan: dict | str | Path) -> DataFrame:
        """The plan's result with plain column names."""
        if isinstance(plan, Path):
            plan = plan.read_text()
        if isinstance(plan, str):
            plan = json.loads(plan)
        df = self.operator(plan)
        names = [c.rpartition("|")[2] for c in df.columns]
        return df.toDF(*(n if names.count(n) == 1 else c.replace("|", ".") for n, c in zip(names, df.columns, strict=True)))

    # expressions
    def expression(self, e: dict, df: DataFrame) -> Column:
        kind = e["expression"]
        if kind in CONSTANTS:
            return F.lit(e["v"]).cast(CONSTANTS[kind])
        if kind in ("date", "datetime"):
            v = e["v"]
            return F.lit(v).cast("timestamp_ntz") if isinstance(v, str) else F.timestamp_millis(F.lit(int(v))).cast("timestamp_ntz")
        if kind == "argument":
            raise PlanError("an argument stands only under a projection")
        if kind == "recordProjection":
            return self.projection(e, df)
        if kind == "recordConstruction":
            return F.struct(*(self.expression(a["e"], df).alias(a["name"]) for a in e["attributes"]))
        if kind in BINARY:
            return BINARY[kind](self.expression(e["left"], df), self.expression(e["right"], df))
        if kind == "div":
            a, b = self.expression(e["left"], df), self.expression(e["right"], df)
            kinds = [df.select(x.alias("x")).schema[0].dataType.simpleString() for x in (a, b)]
            return scalar.int_div(a, b) if all(k in ("int", "bigint") for k in kinds) else scalar.div(a, b)
        if kind == "if":
            return scalar.if_(self.expression(e["cond"], df), self.expression(e["then"], df), self.expression(e["else"], df))
        if kind == "neg":
            return -self.expression(e["e"], df)
        if kind == "is_null":
            return self.expression(e["e"], df).isNull()
        if kind == "is_not_null":
            return self.expression(e["e"], df).isNotNull()
        if kind == "extract":
            return scalar.extract(e["unitrange"], self.expression(e["e"], df))
        if kind == "cast":
            return self.expression(e["e"], df).cast(TYPES[e["type"]["type"]])
        if kind == "extern":
            return scalar.extern(e["name"], *(self.expression(a, df) for a in e["args"]))
        if kind in SHIFTS:  # by a constant
            return SHIFTS[kind](self.expression(e["left"], df), int(e["right"]["v"]))
        if kind == "hash":
            return scalar.hash_of(self.expression(e["e"], df))
        if kind == "rand":
            return scalar.rand(e.get("seed"))
        if kind == "placeholder":
            return F.lit(self.params[e["index"]])
        raise PlanError(f"unknown expression {kind!r}")

    def projection(self, e: dict, df: DataFrame) -> Column:
        attr, inner = e["attribute"], e["e"]
        if inner["expression"] == "argument":
            name = label(attr)
            if name in self.bound:
                return self.bound[name]
            if name in df.columns:
                return F.col(f"`{name}`")
            same = [c for c in df.columns if c.rpartition("|")[2] == attr["attrName"]]
            if len(same) != 1:
                raise PlanError(f"no attribute {name}" if not same else f"{attr['attrName']} isn't unique")
            return F.col(f"`{same[0]}`")
        return self.expression(inner, df)[attr["attrName"]]

    def named(self, e: dict, df: DataFrame, nth: int) -> Column:
        """An expression under the name it registers."""
        inner = e["e"] if "expression" not in e else e
        to = e.get("register_as") or inner.get("register_as") or (inner.get("attribute") if inner["expression"] == "recordProjection" else None)
        return self.expression(inner, df).alias(label(to) if to else f"|e{nth}")

    # operators
    def operator(self, p: dict) -> DataFrame:
        tag = p["operator"]
        if tag in SAME:
            return self.operator(p["input"])
        method = getattr(self, "_" + re.sub(r"\W", "_", tag), None)
        if tag in JOINS:
            return self.chained(p, JOINS[tag])
        if method is None:
            raise PlanError(f"unknown operator {tag!r}")
        return method(p)

    def _scan(self, p: dict) -> DataFrame:
        plugin = p["plugin"]
        name = plugin["name"]
        if name not in self.catalog.entries:  # plans may say the path
            name = next((n for n, e in self.catalog.entries.items() if e.path == name), name)
        df = self.catalog.read(name, [a["attrName"] for a in plugin.get("projections", [])] or None)
        relation = plugin["name"]
        if plugin.get("projections"):
            relation = plugin["projections"][0].get("relName", relation)
        return df.toDF(*(f"{relation}|{c}" for c in df.columns))

    def _values(self, p: dict) -> DataFrame:
        cols = p["values"]
        rows = list(zip(*(c["v"] for c in cols), strict=True))
        schema = ", ".join(f"c{k} {CONSTANTS[c['type']['type']]}" for k, c in enumerate(cols))
        return self.catalog.spark.createDataFrame(rows, schema).toDF(*(f"{p['relName']}|{c['attrName']}" for c in cols))

    def _dict_scan(self, p: dict) -> DataFrame:
        return self.catalog.dictionary(p["relName"], p["attrName"], p["regex"]).toDF(f"{p['relName']}|{p['attrName']}")

    def _project(self, p: dict) -> DataFrame:
        df = self.operator(p["input"])
        return df.select(*(self.named(e, df, k) for k, e in enumerate(p["e"])))

    def _print(self, p: dict) -> DataFrame:
        """The result; with a path in ``plugin`` it is written there too and read back from there."""
        df = self._project(p) if p.get("e") else self.operator(p["input"])
        plugin = p.get("plugin", {})
        if "path" not in plugin:
            return df
        from ..operators.relation import Relation
        from ..sources.sinks import print_to, printed

        plain = df.toDF(*(c.rpartition("|")[2] for c in df.columns))
        print_to(Relation(plain), plugin["path"], plugin.get("type", "pm-csv"))
        return printed(df.sparkSession, plugin["path"], plugin.get("type", "pm-csv"), plain.schema)

    def _bloomfilter_build(self, p: dict) -> DataFrame:
        """Builds the filter ``id`` and passes its input on."""
        from ..operators.relation import Relation

        df = self.operator(p["input"])
        self.filters[p["id"]] = Relation(df).bloom_build(self.expression(p["e"], df), p.get("size", 1 << 22))
        return df

    def _bloomfilter_probe(self, p: dict) -> DataFrame:
        from ..operators.relation import Relation

        df = self.operator(p["input"])
        if p["id"] not in self.filters:
            raise PlanError(f"no filter {p['id']} was built")
        return Relation(df).bloom_probe(self.filters[p["id"]], self.expression(p["e"], df)).df

    _bloomfilter_repack = _bloomfilter_probe  # blocks are Spark's matter

    def _insert_into(self, p: dict) -> DataFrame:
        df = self._print(p)
        df.toDF(*(c.rpartition("|")[2] for c in df.columns)).write.mode("append").parquet(self.catalog.entries[p["name"]].path)
        return df

    def _select(self, p: dict) -> DataFrame:
        df = self.operator(p["input"])
        return df.filter(self.expression(p["p"], df))

    def _reduce(self, p: dict) -> DataFrame:
        df = self.operator(p["input"])
        if "p" in p:
            df = df.filter(self.expression(p["p"], df))
        return df.agg(*self.folds(p["accumulator"], p["e"], df))

    def folds(self, monoids: list[str], exprs: list[dict], df: DataFrame) -> list[Column]:
        out = []
        for k, (m, e) in enumerate(zip(monoids, exprs, strict=True)):
            inner = e["e"] if "expression" not in e else e
            to = e.get("register_as") or inner.get("register_as")
            name = label(to) if to else f"|{m}_{inner['attribute']['attrName']}" if inner["expression"] == "recordProjection" else f"|{m}_{k}"
            out.append(fold(m, self.expression(inner, df)).alias(name))
        return out

    def _groupby(self, p: dict) -> DataFrame:
        df = self.operator(p["input"])
        keys = [self.named(k, df, n) for n, k in enumerate(p["k"])]
        return df.groupBy(*keys).agg(*self.folds([e["m"] for e in p["e"]], p["e"], df))

    _hashgroupby_chained = _groupby

    def _nest(self, p: dict) -> DataFrame:
        df = self.operator(p["input"])
        if "p" in p:
            df = df.filter(self.expression(p["p"], df))
        if "g" in p and p["g"]["expression"] != "recordConstruction":
            df = df.filter(self.expression(p["g"], df).isNotNull())
        keys = [self.named(e, df, n) for n, e in enumerate(a["e"] for a in p["f"]["attributes"])] if p["f"]["expression"] == "recordConstruction" else [self.named(p["f"], df, 0)]
        folds = self.folds(p["accumulator"], p["e"], df)
        return df.groupBy(*keys).agg(*(f.alias(f"|{n}") for f, n in zip(folds, p["aggrLabels"], strict=True)))

    def _sort(self, p: dict) -> DataFrame:
        df = self.operator(p["input"])
        order = [self.expression(e["expression"], df).desc() if e["direction"].upper().startswith("DESC") else self.expression(e["expression"], df).asc() for e in p["e"] if e["direction"].upper() != "NONE"]
        return df.orderBy(*order)

    def _unnest(self, p: dict, outer: bool = False) -> DataFrame:
        df = self.operator(p["input"])
        path, name = self.expression(p["path"]["e"], df), p["path"]["name"]
        item = f"{path_of(p['path']['e'])}|{name}"
        if outer and "p" in p:  # the predicate sees the item while it is in the collection

            def fits(value: Column) -> Column:
                self.bound[item] = value
                try:
                    return self.expression(p["p"], df)
                finally:
                    del self.bound[item]

            return df.withColumn(item, F.explode_outer(F.filter(path, fits)))
        out = df.withColumn(item, F.explode_outer(path) if outer else F.explode(path))
        return out.filter(self.expression(p["p"], out)) if "p" in p else out

    def _outer_unnest(self, p: dict) -> DataFrame:
        return self._unnest(p, True)

    def chained(self, p: dict, hint: str | None) -> DataFrame:
        build, probe = self.operator(p["build_input"]), self.operator(p["probe_input"])
        keys = self.key_pairs(p["build_k"], p["probe_k"], build, probe)
        on = keys[0]
        for k in keys[1:]:
            on = on & k
        from ..operators.relation import hinted

        return probe.join(hinted(build, hint), on, "inner")

    def key_pairs(self, build_k: dict, probe_k: dict, build: DataFrame, probe: DataFrame) -> list[Column]:
        if build_k["expression"] == "recordConstruction":
            return [self.expression(b["e"], build) == self.expression(q["e"], probe) for b, q in zip(build_k["attributes"], probe_k["attributes"], strict=True)]
        return [self.expression(build_k, build) == self.expression(probe_k, probe)]

    def _join(self, p: dict) -> DataFrame:
        if p["p"]["expression"] != "eq":
            raise PlanError("a join has one equality")
        left, right = self.operator(p["leftInput"]), self.operator(p["rightInput"])
        from ..operators.relation import hinted

        return left.join(hinted(right, "shuffle_hash"), self.expression(p["p"]["left"], left) == self.expression(p["p"]["right"], right), "inner")

    def _hash_rearrange(self, p: dict) -> DataFrame:
        df, n = self.operator(p["input"]), p.get("buckets", 2)
        key = self.expression(p["e"], df)
        out = df.repartition(n, key)
        return out.withColumn(label(p["hashProject"]), F.pmod(F.hash(key), F.lit(n))) if "hashProject" in p else out

    _hash_pack = _hash_rearrange

    def _mem_broadcast_device(self, p: dict) -> DataFrame:
        from ..operators.relation import Relation

        return Relation(self.operator(p["input"])).broadcast().df

    def _exchange(self, p: dict) -> DataFrame:
        df = self.operator(p["input"])
        n = p.get("num_of_targets") or p.get("numOfParents") or df.sparkSession.sparkContext.defaultParallelism
        return df.repartition(n, self.expression(p["target"], df)) if "target" in p else df.repartition(n)

    _router = _exchange

    def _union_all(self, p: dict) -> DataFrame:
        first, *rest = map(self.operator, p["input"])
        for df in rest:
            first = first.union(df)
        return first

    def _split(self, p: dict) -> DataFrame:
        """Each mention of a split is one more of its parts, chosen by a hash of the row."""
        df, n = self.operator(p["input"]), p["numOfParents"]
        at = self.shared[p["split_id"]] = self.shared.get(p["split_id"], -1) + 1
        if at >= n:
            raise PlanError("a split has more parents than it says")
        return df.filter(F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(n)) == at)


def path_of(e: dict) -> str:
    return e.get("attribute", {}).get("relName", "")
