"""The schema language: specifications of groups, datasets, attributes and links, their inheritance,
namespaces, and what they compile to. Schemas are small and live on the driver; what they say about
data becomes tables that data is joined with."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.functions import dtypes
from tessera.local import small_frame

MANY = ("*", "+")
#: Quantities in words.
QUANTITIES = {"zero_or_one": "?", "zero_or_many": "*", "one_or_many": "+"}


@dataclass(frozen=True)
class Attribute:
    name: str
    doc: str = ""
    dtype: str | None = None
    shape: tuple | None = None
    dims: tuple | None = None
    required: bool = True
    value: object = None
    default: object = None
    inherited: bool = False
    overridden: bool = False
    target_type: str | None = None  # what a reference must point to

    def __post_init__(self):
        if isinstance(self.dtype, dict):  # a reference: {target_type, reftype}
            object.__setattr__(self, "target_type", self.dtype["target_type"])
            object.__setattr__(self, "dtype", self.dtype.get("reftype", "object"))
        if self.value is not None and self.default is not None:
            raise ValueError("a constant has no default")
        if self.dims is not None and self.shape is None:
            object.__setattr__(self, "shape", tuple([None] * len(self.dims)))


@dataclass(frozen=True)
class Spec:
    """A group, dataset or link. `fields` are the parts of a compound dataset; `type_def` names the
    type that it defines, `type_inc` the one that it extends or holds."""

    kind: str  # group, dataset or link
    name: str | None = None
    doc: str = ""
    type_def: str | None = None
    type_inc: str | None = None
    quantity: str | int = 1
    dtype: str | None = None
    shape: tuple | None = None
    dims: tuple | None = None
    fields: tuple[tuple[str, str], ...] = ()
    attributes: tuple[Attribute, ...] = ()
    children: tuple[Spec, ...] = ()
    linkable: bool = True
    inherited: bool = False
    overridden: bool = False

    def __post_init__(self):
        object.__setattr__(self, "quantity", QUANTITIES.get(self.quantity, self.quantity))
        if self.name is None and self.type_def is None and self.type_inc is None:
            raise ValueError("a specification needs a name or a type")
        if self.name is not None and self.quantity in MANY:
            raise ValueError("a named part can't be many")

    @property
    def data_type(self) -> str | None:
        return self.type_def or self.type_inc

    @property
    def required(self) -> bool:
        return self.quantity not in ("?", "*")

    @property
    def many(self) -> bool:
        return self.quantity in MANY or (isinstance(self.quantity, int) and self.quantity > 1)

    def key(self) -> str:
        return self.name or self.data_type

    def of_type(self, data_type: str, kinds: tuple[str, ...] = ("group", "dataset")) -> Spec | list[Spec] | None:
        """The part that holds a type: the only one, the unnamed one of several, or all of several named ones."""
        found = [c for c in self.children if c.kind in kinds and c.data_type == data_type]
        unnamed = [c for c in found if c.name is None]
        return found[0] if len(found) == 1 else unnamed[0] if len(unnamed) == 1 else found or None

    def target(self, target_type: str) -> Spec | list[Spec] | None:
        """The same for links, by the type that they point to."""
        return self.of_type(target_type, ("link",))

    def dims_of(self, shape: tuple[int, ...]) -> tuple | None:
        """The dimension names of the shape alternative that data of a shape fits, the one with the fewest
        wildcards; None where none fits."""
        several = self.shape is not None and any(isinstance(e, tuple) for e in self.shape)
        alternatives = list(zip(self.shape, self.dims)) if several else [(self.shape, self.dims)]
        fitting = [(sum(e is None for e in s or ()), n, d) for n, (s, d) in enumerate(alternatives) if d is not None and dtypes.shape_fits(s, shape)]
        return min(fitting)[2] if fitting else None

    def paths(self, above: str = "") -> list[tuple[str, Spec]]:
        """All parts with their slash-joined names."""
        own = f"{above}/{self.key()}" if above else self.key()
        return [(own, self), *[p for c in self.children for p in c.paths(own)]]

    def resolve(self, base: Spec) -> Spec:
        """With the base's parts that this doesn't have; its own parts override those of equal key."""
        own_attrs = {a.name: a for a in self.attributes}
        base_attrs = {a.name: a for a in base.attributes}
        attrs = [replace(a, inherited=True) for a in base.attributes if a.name not in own_attrs] + [replace(a, overridden=a.name in base_attrs) for a in self.attributes]
        own, held = {c.key(): c for c in self.children}, {c.key(): c for c in base.children}
        kids = [replace(c, inherited=True) for k, c in held.items() if k not in own]
        kids += [replace(c.resolve(held[k]), overridden=True) if k in held and c.kind == held[k].kind else c for k, c in own.items()]
        if self.dtype and base.dtype and not dtypes.refines(base.dtype, self.dtype):
            raise ValueError(f"{self.dtype} doesn't refine {base.dtype}")
        return replace(self, attributes=tuple(attrs), children=tuple(kids), dtype=self.dtype or base.dtype, shape=self.shape or base.shape, dims=self.dims or base.dims, fields=self.fields or base.fields)

    def own_parts(self) -> Spec:
        """Without what is inherited: what a stored schema needs to keep."""
        return replace(self, attributes=tuple(a for a in self.attributes if not a.inherited), children=tuple(c.own_parts() for c in self.children if not c.inherited))


DEFAULT_KEYS = {"type_def": "data_type_def", "type_inc": "data_type_inc"}


def from_dict(d: dict, kind: str = "group", keys: dict[str, str] | None = None) -> Spec:
    """A specification from YAML-like dicts; `keys` renames the words for type definition and inclusion."""
    k = {**DEFAULT_KEYS, **(keys or {})}
    known = {"name", "doc", "quantity", "dtype", "shape", "dims", "attributes", "groups", "datasets", "links", "linkable", "target_type", "default_name", "value", "default_value", *k.values()}
    unknown = set(d) - known
    if unknown:
        raise ValueError(f"unknown keys {sorted(unknown)}")
    tup = lambda x: tuple(tuple(e) if isinstance(e, list) else e for e in x) if isinstance(x, list) else x
    attributes = tuple(Attribute(a["name"], a.get("doc", ""), a.get("dtype"), tup(a.get("shape")), tup(a.get("dims")), a.get("required", True), a.get("value"), a.get("default_value")) for a in d.get("attributes", ()))
    children = tuple(from_dict(c, kind, keys) for kind, word in (("group", "groups"), ("dataset", "datasets"), ("link", "links")) for c in d.get(word, ()))
    fields = tuple((f["name"], f["dtype"]) for f in d["dtype"]) if isinstance(d.get("dtype"), list) else ()
    return Spec(kind, d.get("name"), d.get("doc", ""), d.get(k["type_def"]), d.get(k["type_inc"]) or d.get("target_type"), d.get("quantity", 1), None if fields else d.get("dtype"), tup(d.get("shape")), tup(d.get("dims")), fields, attributes, children, d.get("linkable", True))


def to_dict(s: Spec, keys: dict[str, str] | None = None) -> dict:
    k = {**DEFAULT_KEYS, **(keys or {})}
    out = {k["type_def"]: s.type_def, ("target_type" if s.kind == "link" else k["type_inc"]): s.type_inc, "name": s.name, "doc": s.doc, "quantity": s.quantity if s.quantity != 1 else None}
    out |= {"dtype": [{"name": n, "dtype": d} for n, d in s.fields] or s.dtype, "shape": list(s.shape) if s.shape else None, "dims": list(s.dims) if s.dims else None, "linkable": None if s.linkable else False}
    out["attributes"] = [{x: v for x, v in (("name", a.name), ("doc", a.doc), ("dtype", {"target_type": a.target_type, "reftype": a.dtype} if a.target_type else a.dtype), ("shape", list(a.shape) if a.shape else None), ("required", None if a.required else False), ("value", a.value), ("default_value", a.default)) if v is not None} for a in s.attributes] or None
    for kind, word in (("group", "groups"), ("dataset", "datasets"), ("link", "links")):
        out[word] = [to_dict(c, keys) for c in s.children if c.kind == kind] or None
    return {x: v for x, v in out.items() if v not in (None, "")}


@dataclass
class Catalog:
    """The types of a namespace, by name."""

    specs: dict[str, Spec] = field(default_factory=dict)

    def register(self, spec: Spec) -> None:
        """Registers a type and those defined within it; a different one of the same name is an error."""
        if spec.type_def:
            held = self.specs.get(spec.type_def)
            if held is not None and held != spec:
                raise ValueError(f"{spec.type_def} is already registered")
            self.specs[spec.type_def] = spec
        for c in spec.children:
            self.register(c)

    def get(self, name: str) -> Spec:
        return self.specs[name]

    def resolved(self, name: str) -> Spec:
        """A type with all that it inherits."""
        spec = self.specs[name]
        return spec.resolve(self.resolved(spec.type_inc)) if spec.type_def and spec.type_inc in self.specs and spec.type_inc != name else spec

    def hierarchy(self, name: str) -> tuple[str, ...]:
        """The type and what it extends, up to the root."""
        out = []
        while name in self.specs and name not in out:
            out.append(name)
            name = self.specs[name].type_inc if self.specs[name].type_inc != name else None
        return tuple(out)

    def subtypes(self, name: str, recursive: bool = True) -> tuple[str, ...]:
        direct = sorted(t for t, s in self.specs.items() if s.type_inc == name and t != name)
        return tuple(direct + [x for d in direct for x in self.subtypes(d)]) if recursive else tuple(direct)

    def is_a(self, name: str, parent: str) -> bool:
        return parent in self.hierarchy(name)

    def closure(self, spark: SparkSession) -> DataFrame:
        """(data_type, ancestor, distance): a type is its own ancestor at distance 0."""
        rows = [(t, a, i) for t in self.specs for i, a in enumerate(self.hierarchy(t))]
        return small_frame(spark, rows, "data_type string, ancestor string, distance int")

    def parts(self, spark: SparkSession) -> tuple[dict[str, DataFrame], int]:
        """All parts of the resolved specifications as tables, and how deep parts without a type of their own nest.

        A part is a type, or what a type says of one of its children (a slot), and so on downwards.
        parts: what a node must be; attributes: what it must have; slots: which children.
        """
        parts, attributes, slots, deepest = [], [], [], 0

        def walk(part: str, s: Spec, path: str, data_type: str | None, depth: int) -> None:
            nonlocal deepest
            deepest = max(deepest, depth)
            dtype = ",".join(d for _, d in s.fields) if s.fields else s.dtype["reftype"] if isinstance(s.dtype, dict) else s.dtype
            parts.append((part, data_type, s.kind, path, dtype, bool(s.fields), _shape_text(s.shape), None if s.shape is None else repr(s.shape)))
            attributes.extend((part, a.name, a.dtype, a.target_type, _shape_text(a.shape), None if a.shape is None else repr(a.shape), a.required) for a in s.attributes)
            order = {"dataset": 0, "group": 1, "link": 2}
            for n, c in enumerate(sorted(s.children, key=lambda c: order[c.kind])):
                own = f"{part}/{n}"
                exact = c.quantity if isinstance(c.quantity, int) else None
                need = exact if exact is not None else int(c.required)
                content = c.kind != "link" and bool(c.attributes or c.children or c.dtype or c.fields or c.shape)
                slots.append((part, n, own, c.kind, f"{path}/{c.key()}", c.name, c.data_type, str(c.quantity), exact, need, c.required, c.many, c.linkable, content))
                if c.kind != "link":
                    walk(own, c, f"{path}/{c.key()}", None, depth + 1)

        for t in self.specs:
            walk(t, self.resolved(t), t, t, 0)
        return {
            "parts": small_frame(spark, parts, "part string, data_type string, part_kind string, part_path string, want string, compound boolean, want_shape string, want_shape_text string"),
            "attributes": small_frame(spark, attributes, "part string, attr string, want string, target_type string, want_shape string, want_shape_text string, required boolean"),
            "slots": small_frame(spark, slots, "part string, slot_no int, slot string, slot_kind string, slot_path string, slot_name string, slot_type string, quantity string, exact int, need int, required boolean, many boolean, linkable boolean, content boolean"),
        }, deepest

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The resolved specifications as tables: attributes and children wanted of each type."""
        attrs, kids = [], []
        for t in self.specs:
            s = self.resolved(t)
            attrs += [(t, None, a.name, a.dtype, _shape_text(a.shape), a.required, a.inherited, a.overridden) for a in s.attributes]
            if s.kind == "dataset":
                continue
            for i, c in enumerate(s.children):
                kids.append((t, i, c.kind, c.name, c.data_type, str(c.quantity), c.dtype, _shape_text(c.shape), c.required, c.many, c.linkable))
                attrs += [(t, c.name, a.name, a.dtype, _shape_text(a.shape), a.required, a.inherited, a.overridden) for a in c.attributes if c.name and not c.data_type]
        return {
            "attributes": small_frame(spark, attrs, "data_type string, child string, name string, dtype string, shape string, required boolean, inherited boolean, overridden boolean"),
            "children": small_frame(spark, kids, "data_type string, slot int, kind string, name string, child_type string, quantity string, dtype string, shape string, required boolean, many boolean, linkable boolean"),
        }


def _shape_text(shape) -> str | None:
    """A shape as text: * for any length, | between alternatives."""
    if shape is None:
        return None
    if any(isinstance(e, tuple) for e in shape):
        return "|".join(_shape_text(e) for e in shape)
    return ",".join("*" if e is None else str(e) for e in shape)


@dataclass
class Namespace:
    name: str
    version: str
    doc: str = ""
    author: str = ""
    catalog: Catalog = field(default_factory=Catalog)
    sources: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self):
        if any(c.isspace() for c in self.name):
            raise ValueError("a namespace's name has no white space")


@dataclass
class NamespaceCatalog:
    namespaces: dict[str, Namespace] = field(default_factory=dict)

    def add(self, ns: Namespace) -> None:
        if ns.name in self.namespaces:
            raise KeyError(f"{ns.name} is already loaded")
        self.namespaces[ns.name] = ns

    def get(self, name: str) -> Namespace:
        return self.namespaces[name]

    def types(self, name: str) -> tuple[str, ...]:
        return tuple(self.namespaces[name].catalog.specs) if name in self.namespaces else ()

    def merge(self, other: NamespaceCatalog) -> None:
        for ns in other.namespaces.values():
            self.add(ns)

    def load(self, path: str, keys: dict[str, str] | None = None) -> list[str]:
        """Loads a namespace file and its sources. One that is loaded already is left as it is."""
        import yaml

        found, folder = yaml.safe_load(Path(path).read_text()), Path(path).parent
        out = []
        for d in found["namespaces"]:
            if d["name"] in self.namespaces:
                continue
            ns = Namespace(d["name"], str(d.get("version", "unversioned")), d.get("doc", ""), str(d.get("author", "")))
            for part in d["schema"]:
                if "namespace" in part:
                    base = self.namespaces[part["namespace"]].catalog
                    wanted = part.get("data_types") or list(base.specs)
                    for t in wanted:
                        for a in base.hierarchy(t):
                            ns.catalog.specs.setdefault(a, base.specs[a])
                else:
                    doc = yaml.safe_load((folder / part["source"]).read_text())
                    specs = [from_dict(x, kind, keys) for kind, word in (("group", "groups"), ("dataset", "datasets")) for x in doc.get(word, ())]
                    for s in specs:
                        ns.catalog.register(s)
                    ns.sources[part["source"]] = [s.type_def for s in specs if s.type_def]
            self.add(ns)
            out.append(ns.name)
        return out

    def export(self, name: str, folder: str) -> None:
        """Writes a namespace file and one file with its types."""
        import yaml

        ns = self.namespaces[name]
        specs = {"groups": [to_dict(s.own_parts()) for s in ns.catalog.specs.values() if s.kind == "group"], "datasets": [to_dict(s.own_parts()) for s in ns.catalog.specs.values() if s.kind == "dataset"]}
        Path(folder, f"{name}.extensions.yaml").write_text(yaml.safe_dump({k: v for k, v in specs.items() if v}, sort_keys=False))
        head = {"name": name, "version": ns.version, "doc": ns.doc, "author": ns.author, "schema": [{"source": f"{name}.extensions.yaml"}]}
        Path(folder, f"{name}.namespace.yaml").write_text(yaml.safe_dump({"namespaces": [head]}, sort_keys=False))


@dataclass
class NamespaceBuilder:
    """Authoring of a namespace: its types by source file, and what it includes of others."""

    name: str
    version: str
    doc: str = ""
    author: str = ""
    sources: dict[str, list[Spec]] = field(default_factory=dict)
    included: list[tuple[str, str | None]] = field(default_factory=list)  # (namespace, type or None for all)

    def __post_init__(self):
        if not self.version:
            raise ValueError("a namespace needs a version")

    def add_source(self, source: str) -> None:
        self.sources.setdefault(source, [])

    def add_spec(self, source: str, spec: Spec) -> None:
        if spec.type_def is None:
            raise ValueError("only a specification that defines a type can be added")
        self.sources.setdefault(source, []).append(spec)

    def include_type(self, data_type: str, namespace: str) -> None:
        self.included.append((namespace, data_type))

    def include_namespace(self, namespace: str) -> None:
        self.included.append((namespace, None))

    def export(self, folder: str) -> str:
        """Writes a file for each source and the namespace file, whose path it returns."""
        import yaml

        schema: list[dict] = []
        for ns in dict.fromkeys(n for n, _ in self.included):
            types = [t for n, t in self.included if n == ns]
            schema.append({"namespace": ns} if None in types else {"namespace": ns, "data_types": types})
        for source, specs in self.sources.items():
            words = {"group": "groups", "dataset": "datasets"}
            doc = {word: [to_dict(s.own_parts()) for s in specs if s.kind == kind] for kind, word in words.items()}
            Path(folder, source).write_text(yaml.safe_dump({k: v for k, v in doc.items() if v}, sort_keys=False))
            schema.append({"source": source})
        path = Path(folder, f"{self.name}.namespace.yaml")
        head = {"name": self.name, "version": self.version, "doc": self.doc, "author": self.author, "schema": schema}
        path.write_text(yaml.safe_dump({"namespaces": [head]}, sort_keys=False))
        return str(path)


def problems(d: dict, kind: str = "group", keys: dict[str, str] | None = None, path: str = "") -> list[str]:
    """What is wrong with the structure of a specification as a dict, each with where it stands."""
    k = {**DEFAULT_KEYS, **(keys or {})}
    here = f"{path}/{d.get('name') or d.get(k['type_def']) or d.get(k['type_inc']) or d.get('target_type') or '?'}"
    out = []
    if not any(d.get(x) for x in ("name", k["type_def"], k["type_inc"], "target_type")):
        out.append(f"{here}: neither a name nor a type")
    if not isinstance(d.get("doc"), str):
        out.append(f"{here}: no doc")
    if kind == "link" and not d.get("target_type"):
        out.append(f"{here}: a link without a target_type")
    quantity = d.get("quantity", 1)
    if quantity not in ("?", "*", "+", *QUANTITIES) and not (isinstance(quantity, int) and quantity > 0):
        out.append(f"{here}: quantity {quantity!r}")
    for a in d.get("attributes", ()):
        if not a.get("name"):
            out.append(f"{here}: an attribute without a name")
        dtype = a.get("dtype")
        if isinstance(dtype, str) and dtype not in dtypes.CANONICAL or isinstance(dtype, dict) and "target_type" not in dtype:
            out.append(f"{here}.{a.get('name')}: dtype {dtype!r}")
    dtype = d.get("dtype")
    if isinstance(dtype, str) and dtype not in dtypes.CANONICAL:
        out.append(f"{here}: dtype {dtype!r}")
    for inner, word in (("group", "groups"), ("dataset", "datasets"), ("link", "links")):
        if kind == "dataset" and d.get(word):
            out.append(f"{here}: a dataset with {word}")
        for c in d.get(word, ()):
            out += problems(c, inner, keys, here)
    return out


def latest_versions(specs: DataFrame) -> DataFrame:
    """Of rows (namespace, version, ...) those of the last version by text order; `unversioned` and
    `None` count only where there is no other."""
    from pyspark.sql import functions as F

    rank = F.when(F.col("version").isin("unversioned", "None"), F.concat(F.lit("0"), "version")).otherwise(F.concat(F.lit("1"), "version"))
    last = specs.groupBy("namespace").agg(F.max_by("version", rank).alias("version"))
    return specs.join(last, ["namespace", "version"], "left_semi")


def order_dependencies(deps: dict[str, list[str]]) -> list[str]:
    """Namespaces with those they need before them."""
    out: list[str] = []

    def visit(n: str, above: tuple = ()):
        if n in above:
            raise ValueError(f"{n} needs itself")
        for d in deps.get(n, ()):
            visit(d, (*above, n))
        if n not in out:
            out.append(n)

    for n in deps:
        visit(n)
    return out


def compile_schema(spec: Spec) -> T.StructType:
    """The columns of a table type: its datasets, with what they mean as metadata."""
    fields = []
    for c in spec.children:
        if c.kind != "dataset" or not c.name:
            continue
        kind = T.StructType([T.StructField(n, dtypes.spark_type(d)) for n, d in c.fields]) if c.fields else dtypes.spark_type(c.dtype or "utf")
        for _ in range(max(0, len(c.shape) - 1) if c.shape and not isinstance(c.shape[0], tuple) else 0):
            kind = T.ArrayType(kind)
        meta = {"description": c.doc, "dtype": c.dtype or "", "unsigned": bool(c.dtype and c.dtype.startswith("uint")), "shape": _shape_text(c.shape) or "", "dims": ",".join(map(str, c.dims or ()))}
        fields.append(T.StructField(c.name, kind, True, meta))
    return T.StructType(fields)
