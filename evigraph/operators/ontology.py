"""Classes: canonical names, compatibility, closures, hierarchies and the incremental schema."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import RELATIONS
from ..functions.text import normalize_class
from .retrieval import cut

# ---------------------------------------------------------------- tables


def canonicalize(rows: DataFrame, canonical: DataFrame, name: str = "name") -> DataFrame:
    """Adds canonical: the exact entry, else the first entry that agrees but for case, else the name.

    canonical: raw, canonical, pos.
    """
    exact = canonical.select(F.col("raw").alias("_r"), F.col("canonical").alias("_exact"))
    loose = canonical.groupBy(F.lower("raw").alias("_l")).agg(F.min_by("canonical", "pos").alias("_loose"))
    out = rows.join(exact, F.col(name) == F.col("_r"), "left").join(loose, F.lower(name) == F.col("_l"), "left")
    return out.withColumn("canonical", F.coalesce("_exact", "_loose", name)).drop("_r", "_exact", "_l", "_loose")


def compatibility(a: Column, b: Column, weight: float = 1.0) -> Column:
    """`weight` if two class lists share a canonical class, else 0 (nulls: 0)."""
    return F.when(F.coalesce(F.arrays_overlap(a, b), F.lit(False)), F.lit(weight)).otherwise(F.lit(0.0))


def entity_compatibility(activated: DataFrame, classes: DataFrame, types: DataFrame, canonical: DataFrame | None = None, weight: float = 1.0) -> DataFrame:
    """qid, entity, compat above 0: activated entities (qid, entity) that have a class the answer may have.

    classes: entity, classes (as usable_classes() leaves them); types: qid, types, whose names are made canonical here.
    Only the pairs of a question and an entity that it activated are compared, by an equi-join on the class.
    """
    own = classes.select("entity", F.explode("classes").alias("class")).distinct()
    asked = types.select("qid", F.explode("types").alias("name")).withColumn("name", normalize_class(F.col("name"))).filter("name <> ''")
    asked = canonicalize(asked, canonical) if canonical is not None else asked.withColumn("canonical", F.col("name"))
    met = activated.select("qid", "entity").distinct().join(own, "entity").join(asked.select("qid", F.col("canonical").alias("class")).distinct(), ["qid", "class"])
    return met.select("qid", "entity").distinct().withColumn("compat", F.lit(weight))


def closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(ancestor, descendant) pairs of parent-child edges, by repeated doubling; cycles end as nothing new is found."""
    pairs = cut(edges.select(F.col("parent").alias("a"), F.col("child").alias("d")).distinct())
    n = pairs.count()
    for _ in range(max_rounds):
        more = pairs.alias("x").join(pairs.alias("y"), F.col("x.d") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.d").alias("d"))
        pairs = cut(pairs.unionByName(more).distinct())
        if (m := pairs.count()) == n:
            break
        n = m
    else:
        raise RuntimeError("closure: no fixed point")
    return pairs.select(F.col("a").alias("ancestor"), F.col("d").alias("descendant"))


def reduction(edges: DataFrame) -> DataFrame:
    """Edges of an acyclic graph that no longer path implies."""
    e = edges.select("parent", "child").distinct()
    far = e.join(closure(e).select(F.col("ancestor").alias("child"), "descendant"), "child").select("parent", F.col("descendant").alias("child"))
    return e.join(far.distinct(), ["parent", "child"], "left_anti")


def groups(names: DataFrame, pairs: DataFrame, max_rounds: int = 64) -> DataFrame:
    """name, representative: equivalence classes; the representative has the highest frequency, then is shortest, then first.

    names: name, freq; pairs: a, b.  Labels spread by minimum with pointer jumping.
    """
    label = cut(names.select("name", F.col("name").alias("label")))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    for _ in range(max_rounds):
        seen = both.join(label.withColumnsRenamed({"name": "b", "label": "l"}), "b").groupBy("a").agg(F.min("l").alias("l"))
        new = label.join(seen, label["name"] == seen["a"], "left").select("name", F.least("label", F.coalesce("l", "label")).alias("label"))
        jump = new.select(F.col("name").alias("label"), F.col("label").alias("up"))
        new = cut(new.join(jump, "label", "left").select("name", F.least("label", F.coalesce("up", "label")).alias("label")))
        if new.exceptAll(label).isEmpty():
            break
        label = new
    else:
        raise RuntimeError("groups: no fixed point")
    joined = label.join(names, "name")
    best = joined.groupBy("label").agg(F.min_by("name", F.struct(-F.col("freq"), F.length("name"), "name")).alias("representative"))
    return joined.join(best, "label").select("name", "representative")


def class_frequency(annotations: DataFrame, min_freq: int = 1, limit: int = 0) -> DataFrame:
    """class, freq in order: frequent first, then by lower-cased name.  annotations: classes array<string>."""
    out = annotations.select(F.explode("classes").alias("class")).groupBy("class").agg(F.count("*").alias("freq")).filter(F.col("freq") >= min_freq).orderBy(F.desc("freq"), F.lower("class"), "class")
    return out.limit(limit) if limit else out


def clean_path(path: Column) -> Column:
    """Trimmed names of a path up to the first that occurred before, whatever its case; blank ones are left out."""
    names = F.filter(F.transform(path, lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(names, lambda x: F.lower(x))
    repeat = F.array_position(F.transform(low, lambda x, i: F.array_position(low, x) == i + 1), False)
    return F.slice(names, 1, F.when(repeat == 0, F.size(names)).otherwise(repeat.cast("int") - 1))


def path_edges(paths: DataFrame, examples: int = 5, salts: int = 64) -> DataFrame:
    """parent, child, support, depth, examples of class paths (entity, pos, path array): consecutive names of cleaned paths.

    depth is that of the first occurrence, examples the first entities.  Examples are chosen in `salts` parts of an edge
    first, so an edge that most entities share is no single task's work.
    """
    steps = paths.select("pos", "entity", clean_path(F.col("path")).alias("path")).filter(F.size("path") >= 2)
    step = steps.select("pos", "entity", F.posexplode(F.expr("transform(sequence(0, size(path) - 2), i -> struct(path[i] as parent, path[i + 1] as child))")).alias("depth", "e"))
    rows = step.select("pos", "entity", "depth", "e.parent", "e.child").filter("parent <> child")
    counts = rows.groupBy("parent", "child").agg(F.count("*").alias("support"), F.min_by("depth", F.struct("pos", "depth")).alias("depth"))
    part = rows.withColumn("salt", F.pmod(F.xxhash64("pos", "entity"), F.lit(salts)))
    first = part.withColumn("r", F.row_number().over(Window.partitionBy("parent", "child", "salt").orderBy("pos", "depth"))).filter(F.col("r") <= examples)
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("parent", "child").orderBy("pos", "depth"))).filter(F.col("r") <= examples)
    shown = ranked.groupBy("parent", "child").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "entity"))), lambda x: x["entity"]).alias("examples"))
    return counts.join(shown, ["parent", "child"])


def acyclic(edges: list[tuple[str, str, int, int]]) -> tuple[list[tuple[str, str]], list[tuple[str, str, str]]]:
    """Greedy choice of (parent, child, support, depth) edges without a cycle: kept, and removed with the reason.

    Edges are one a class pair, so few; the choice depends on its order: support, depth, names.
    """
    down: dict[str, set[str]] = defaultdict(set)
    kept, removed = [], []
    for p, c, _, _ in sorted(edges, key=lambda e: (-e[2], e[3], e[0], e[1])):
        if p == c:
            removed.append((p, c, "self_loop"))
        elif reaches(down, c, p):
            removed.append((p, c, "cycle"))
        else:
            down[p].add(c)
            kept.append((p, c))
    return kept, removed


def reaches(down: dict[str, set[str]], a: str, b: str) -> bool:
    stack, seen = [a], {a}
    while stack:
        x = stack.pop()
        if x == b:
            return True
        stack += [y for y in down.get(x, ()) if y not in seen]
        seen |= set(down.get(x, ()))
    return False


# ---------------------------------------------------------------- incremental schema

#: Relation seen from the first class, confidence and, optionally, a reason.
Judge = Callable[[str, str], tuple]
INVERSE = {"A_PARENT_B": "B_PARENT_A", "B_PARENT_A": "A_PARENT_B"}


def _closure_of(start: str, links: dict[str, set[str]]) -> set[str]:
    """A node and everything that links lead to."""
    seen, stack = {start}, [start]
    while stack:
        more = links.get(stack.pop(), set()) - seen
        seen |= more
        stack += more
    return seen


@dataclass
class Schema:
    """Equivalence classes, a reduced subclass graph and related pairs, built class by class with a judge.

    Judging is the caller's (a model or a table), a layer's pairs on `workers` threads; asked pairs are remembered, what the
    graph implies is not asked, and a judge that fails leaves the pair UNCERTAIN.
    """

    freq: dict[str, int]
    judge: Judge
    threshold: float = 0.0
    multi_parent: bool = False
    workers: int = 4
    up: dict[str, str] = field(default_factory=dict)
    children: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    above: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    inserted: list[str] = field(default_factory=list)
    related: set[tuple[str, str]] = field(default_factory=set)
    unrelated: set[tuple[str, str]] = field(default_factory=set)
    uncertain: set[tuple[str, str]] = field(default_factory=set)
    conflicts: list[dict] = field(default_factory=list)
    asked: dict[tuple[str, str], dict] = field(default_factory=dict)
    records: list[dict] = field(default_factory=list)
    insertions: list[dict] = field(default_factory=list)
    hits: int = 0
    pruned: int = 0

    def find(self, name: str) -> str:
        while self.up.get(name, name) != name:
            self.up[name] = self.up.get(self.up[name], self.up[name])
            name = self.up[name]
        return name

    def union(self, a: str, b: str) -> str:
        a, b = self.find(a), self.find(b)
        if a == b:
            return a
        keep, gone = sorted((a, b), key=lambda n: (-self.freq.get(n, 0), len(n), n))
        self.up[gone] = keep
        moved = [(gone, c) for c in sorted(self.children.get(gone, ()))] + [(p, gone) for p in sorted(self.above.get(gone, ()))]
        for p, c in moved:
            self._unlink(p, c)
        for p, c in moved:
            self.subclass(keep if p == gone else p, keep if c == gone else c)
        self.related = {pair(self.find(x), self.find(y)) for x, y in self.related if self.find(x) != self.find(y)}
        return keep

    def _unlink(self, parent: str, child: str) -> None:
        self.children[parent].discard(child)
        self.above[child].discard(parent)

    def is_ancestor(self, a: str, b: str) -> bool:
        """Whether a path leads from a down to b."""
        return self.find(a) != self.find(b) and reaches(self.children, self.find(a), self.find(b))

    def is_related(self, a: str, b: str) -> bool:
        return pair(self.find(a), self.find(b)) in self.related

    def parents(self, name: str) -> list[str]:
        return sorted(self.above.get(name, ()))

    def _ordered(self, names) -> list[str]:
        return sorted(names, key=lambda n: (-self.freq.get(n, 0), n.lower()))

    def roots(self) -> list[str]:
        return self._ordered(r for r in {self.find(n) for n in self.inserted} if not self.above.get(r))

    def subclass(self, parent: str, child: str) -> bool:
        """Adds an edge unless it closes a cycle (a conflict) or is implied; edges that it implies go."""
        parent, child = self.find(parent), self.find(child)
        if parent == child:
            return False
        if reaches(self.children, child, parent):
            self.conflicts.append({"type": "cycle_conflict", "parent": parent, "child": child})
            return False
        if reaches(self.children, parent, child):
            return True
        higher, lower = _closure_of(parent, self.above), _closure_of(child, self.children)
        for p in higher:
            for c in self.children.get(p, set()) & lower:
                self._unlink(p, c)
        self.children[parent].add(child)
        self.above[child].add(parent)
        self.related.discard(pair(parent, child))
        return True

    def _ask(self, name: str, other: str) -> dict:
        try:
            got, sure, *why = self.judge(name, other)
        except Exception as e:  # noqa: BLE001  any error of a remote model leaves the pair open
            got, sure, why = "UNCERTAIN", 0.0, [str(e)]
        got = str(got).strip().upper()
        return {"class_a": name, "class_b": other, "relation": got if sure >= self.threshold and got in RELATIONS else "UNCERTAIN", "confidence": float(sure), "reason": why[0] if why else ""}

    def compare(self, name: str, layer: list[str]) -> list[tuple[str, str, float]]:
        """(relation seen from `name`, member, confidence), most confident first."""
        name = self.find(name)
        others = [o for o in dict.fromkeys(map(self.find, layer)) if o != name]
        known = {o: ("A_PARENT_B" if reaches(self.children, name, o) else "B_PARENT_A" if reaches(self.children, o, name) else None) for o in others}
        self.pruned += sum(v is not None for v in known.values())
        new = [o for o in others if known[o] is None and pair(name, o) not in self.asked]
        self.hits += sum(known[o] is None for o in others) - len(new)
        if new:
            with ThreadPoolExecutor(min(self.workers, len(new))) as pool:
                for o, record in zip(new, pool.map(lambda o: self._ask(name, o), new), strict=True):
                    self.asked[pair(name, o)] = record
                    self.records.append(record)
        out = []
        for o in others:
            if known[o] is not None:
                out.append((known[o], o, 1.0))
                continue
            record = self.asked[pair(name, o)]
            turned = record["class_a"] == o and record["class_b"] == name
            out.append((INVERSE.get(record["relation"], record["relation"]) if turned else record["relation"], o, record["confidence"]))
        return sorted(out, key=lambda x: (-x[2], x[1].lower()))

    def insert(self, name: str) -> None:
        """Places one more class below or above the roots, or as a root of its own."""
        log: list[dict] = []
        before = self.find(name)
        if not self.inserted:
            log.append({"action": "first_root", "class": name})
        elif not self._place(before, None, self.roots(), log):
            log.append({"action": "independent_root", "class": self.find(name)})
        self.inserted.append(name)
        self.insertions.append({"class": name, "canonical_class_before": before, "actions": log})

    def _place(self, name: str, parent: str | None, layer: list[str], log: list[dict]) -> bool:
        """Compares with one layer (the roots, or a parent's children) and descends; whether the class found its place."""
        got = self.compare(name, layer)
        of = lambda kind: [m for r, m, _ in got if r == kind]
        if same := of("EQUIVALENT"):
            log.append({"action": "equivalent", "member": same[0], "representative": self.union(name, same[0])})
            return True
        for m in of("RELATED"):
            if not reaches(self.children, name, m) and not reaches(self.children, m, name):
                self.related.add(pair(name, m))
        for kind, held in (("UNRELATED", self.unrelated), ("UNCERTAIN", self.uncertain)):
            held |= {pair(name, m) for m in of(kind)}
        log += [{"action": r.lower(), "member": m} for r, m, _ in got if r in ("RELATED", "UNRELATED", "UNCERTAIN")]
        placed, below, above = False, of("A_PARENT_B"), of("B_PARENT_A")
        if parent is None:
            for m in below:
                if self.subclass(name, m):
                    placed = True
                    log.append({"action": "parent_of_root", "member": m})
        elif below and self.subclass(parent, name):
            placed = True
            for m in map(self.find, below):
                if m != name:
                    self._unlink(parent, m)
                    self.subclass(name, m)
            log.append({"action": "intermediate", "parent": parent, "children": sorted(map(self.find, below))})
        for m in above if self.multi_parent else above[:1]:
            log.append({"action": "descend", "parent": m})
            placed |= self._place(name, m, self._ordered(self.children.get(m, ())), log)
        if not placed and parent is not None:
            placed = self.subclass(parent, name)
            if placed:
                log.append({"action": "direct_child", "parent": parent})
        return placed

    def export(self) -> dict:
        names = sorted(set(self.freq) | set(self.inserted))
        edges = sorted((p, c) for p, cs in self.children.items() for c in cs)
        members = defaultdict(list)
        for n in names:
            members[self.find(n)].append(n)
        groups = [sorted(g) for _, g in sorted(members.items()) if len(g) > 1]
        related = sorted({pair(self.find(a), self.find(b)) for a, b in self.related if self.find(a) != self.find(b) and not self.is_ancestor(a, b) and not self.is_ancestor(b, a)})
        canonical = sorted({self.find(n) for n in self.inserted})
        roots = self.roots()
        return {
            "class_statistics": {
                "num_raw_classes": len(self.freq),
                "num_inserted_classes": len(canonical),
                "num_canonical_inserted_classes": len(canonical),
                "num_roots": len(roots),
                "num_equivalence_groups": len(groups),
                "num_subclass_edges": len(edges),
                "num_related_edges": len(related),
                "num_unrelated_pairs": len(self.unrelated),
                "num_uncertain_pairs": len(self.uncertain),
            },
            "runtime_statistics": {"num_llm_calls": len(self.records), "num_cache_hits": self.hits, "num_pruned_pairs": self.pruned, "schema_max_workers": self.workers, "allow_multi_parent": self.multi_parent},
            "class_frequency": dict(self.freq),
            "roots": roots,
            "canonical_classes": canonical,
            "canonical_map": {n: self.find(n) for n in names},
            "equivalence_groups": groups,
            "subclass_edges": edges,
            "related_edges": related,
            "unrelated_pairs": sorted(self.unrelated),
            "uncertain_pairs": sorted(self.uncertain),
            "conflict_records": self.conflicts,
            "llm_relation_records": self.records,
            "insertion_records": self.insertions,
        }


def pair(a: str, b: str) -> tuple[str, str]:
    return (a, b) if a <= b else (b, a)


def build_schema(ordered: list[tuple[str, int]], judge: Judge, limit: int = 0, every: int = 0, save: Callable[[dict], None] | None = None, **options) -> Schema:
    """Inserts classes in order, saving after each `every` of them; what is saved also tells how far the run is."""
    schema, some = Schema(dict(ordered), judge, **options), ordered[:limit] if limit else ordered
    for k, (name, _) in enumerate(some, 1):
        schema.insert(name)
        if every and save and k % every == 0:
            save(schema.export() | {"progress": {"processed": k, "total": len(some)}})
    return schema
