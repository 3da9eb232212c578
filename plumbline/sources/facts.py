"""Facts from Python source text: one parse of each file, all facts from it.

The text is parsed, never run. Every fact is a row (state, path, module, kind,
name, data) with its details as JSON, so that the one Python pass is written
once and each fact table is a typed view of it.
"""

from __future__ import annotations

import ast
import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import ship, written

LEAST_TOKENS = 12
# The words of an identifier, and the labels in body_tokens.
WORD = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")
FIELDS = {
    "function": "lineno int, tokens array<string>, args array<string>, calls array<string>, doc string, name_tokens array<string>",
    "import": "target string, level int, symbol string, runtime boolean",
    "literal": "lit_type string, lit_repr string",
    "class": "is_abstract boolean, shape string, fields array<string>, top_level boolean",
    "key": "key string, n long",
    "param": "site string, used array<string>, passed_whole boolean",
    "surface": "what string, params array<struct<kind:string,name:string,has_default:boolean>>, defaults array<string>",
    "segment": "lineno int, text string",
    "module": "n_lines int",
    "unreadable": "error string",
}


def body_tokens(node: ast.FunctionDef | ast.AsyncFunctionDef) -> list[str]:
    """The shape of a function's body: node types, with names and values of no account.

    A call is CALL and CALLEE_<name>, its receiver, arguments and keywords; a call
    of anything else than a name or attribute adds its own type and children.
    Attributes are ATTR_<name>, names NAME, arguments ARG, constants CONST_<type>.
    """
    out: list[str] = []
    todo: list[ast.AST | str] = list(reversed(node.body))
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            out.append(at)
        elif isinstance(at, ast.Call):
            out.append("CALL")
            callee, rest = at.func, [*at.args, *at.keywords]
            if isinstance(callee, ast.Name):
                todo += reversed([f"CALLEE_{callee.id}", *rest])
            elif isinstance(callee, ast.Attribute):
                todo += reversed([f"CALLEE_{callee.attr}", callee.value, *rest])
            else:
                todo += reversed(["Call", callee, *rest])
        elif isinstance(at, ast.Constant):
            out.append(f"CONST_{type(at.value).__name__}")
        else:
            label = {ast.Attribute: lambda: f"ATTR_{at.attr}", ast.Name: lambda: "NAME", ast.arg: lambda: "ARG"}.get(type(at), lambda: type(at).__name__)()
            out.append(label)
            todo += reversed(list(ast.iter_child_nodes(at)))  # contexts and annotations included
    return out


def _name(node: ast.AST | None) -> str:
    """Dotted name of a name or attribute chain, else empty."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


def _type_checking(node: ast.AST) -> bool:
    return isinstance(node, ast.If) and _name(node.test).split(".")[-1] == "TYPE_CHECKING"


def _walk(tree: ast.AST) -> Iterator[tuple[ast.AST, bool]]:
    """All nodes, with whether they can run (not only for type checkers)."""
    todo: list[tuple[ast.AST, bool]] = [(tree, True)]
    while todo:
        node, runs = todo.pop()
        yield node, runs
        for child in ast.iter_child_nodes(node):
            skipped = _type_checking(node) and child in node.body
            todo.append((child, runs and not skipped))


def parameters(args: ast.arguments) -> list[dict]:
    spec = []
    plain = [("posonly", a) for a in args.posonlyargs] + [("normal", a) for a in args.args]
    first = len(plain) - len(args.defaults)
    spec += [{"kind": k, "name": a.arg, "has_default": i >= first} for i, (k, a) in enumerate(plain)]
    spec += [{"kind": "varargs", "name": args.vararg.arg, "has_default": False}] if args.vararg else []
    spec += [{"kind": "kwonly", "name": a.arg, "has_default": d is not None} for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True)]
    spec += [{"kind": "varkw", "name": args.kwarg.arg, "has_default": False}] if args.kwarg else []
    return spec


def default_texts(args: ast.arguments) -> list[str | None]:
    """The source of each parameter's default in the order of `parameters`, null without one."""
    plain = [*args.posonlyargs, *args.args]
    each: list[ast.AST | None] = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
    each += [None] * (args.vararg is not None) + list(args.kw_defaults) + [None] * (args.kwarg is not None)
    return [ast.unparse(d) if d is not None else None for d in each]


def _decorators(node) -> set[str]:
    return {_name(d.func if isinstance(d, ast.Call) else d).split(".")[-1] for d in node.decorator_list}


def _class_facts(node: ast.ClassDef) -> dict:
    bases = {_name(b.value if isinstance(b, ast.Subscript) else b).split(".")[-1] for b in node.bases}
    meta = {_name(k.value).split(".")[-1] for k in node.keywords if k.arg == "metaclass"}
    marked = any(_decorators(f) & {"abstractmethod", "abstractproperty"} for f in node.body if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef))
    shape = "dataclass" if "dataclass" in _decorators(node) else next((b for b in ("TypedDict", "NamedTuple") if b in bases), "")
    fields = sorted({s.target.id for s in node.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name)})
    return {"is_abstract": bool(bases & {"ABC", "Protocol"} or meta & {"ABCMeta"} or marked), "shape": shape, "fields": fields}


def _function_facts(node) -> dict:
    args = [p["name"] for p in parameters(node.args)]
    calls = {_name(c.func).split(".")[-1] for c in ast.walk(node) if isinstance(c, ast.Call)} - {""}
    doc = (ast.get_docstring(node) or "").strip().split("\n")[0]
    names = [w.lower() for p in re.split(r"[_\W]+", node.name) for w in WORD.findall(p)]
    return {"lineno": node.lineno, "tokens": body_tokens(node), "args": [a for a in args if a not in ("self", "cls")], "calls": sorted(calls), "doc": doc, "name_tokens": names}


def _parameter_use(node) -> Iterator[tuple[str, dict]]:
    for p in [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs) if a.arg not in ("self", "cls")]:
        used, whole = set(), False
        called = {id(c.func) for c in ast.walk(node) if isinstance(c, ast.Call)}
        for n in ast.walk(node):
            if isinstance(n, ast.Subscript) and _name(n.value) == p and isinstance(n.slice, ast.Constant) and isinstance(n.slice.value, str):
                used.add(n.slice.value)
            elif isinstance(n, ast.Attribute) and _name(n.value) == p and id(n) not in called:
                used.add(n.attr)
            elif isinstance(n, ast.Call):
                whole |= any(isinstance(a, ast.Name) and a.id == p for a in (*n.args, *(k.value for k in n.keywords)))
        yield p, {"site": node.name, "used": sorted(used), "passed_whole": whole}


def _segment(lines: list[bytes], node: ast.AST) -> str:
    """The source of a node, from the file's lines."""
    own = lines[node.lineno - 1 : node.end_lineno]
    own[-1] = own[-1][: node.end_col_offset]
    own[0] = own[0][node.col_offset :]
    return b"".join(own).decode()


def _surface_of(node: ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) -> Iterator[tuple[str, dict]]:
    """(name below the module, data) of a public function, or of a class, its constructor and its public methods."""
    if not isinstance(node, ast.ClassDef):
        yield node.name, {"what": "function", "params": parameters(node.args), "defaults": default_texts(node.args)}
        return
    methods = {f.name: f for f in node.body if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef)}
    made = methods.pop("__init__", None)
    yield node.name, {"what": "class"} | (_bound(made) if made else {"params": [], "defaults": []})
    for name, f in methods.items():
        if not name.startswith("_"):
            yield f"{node.name}.{name}", {"what": "method"} | _bound(f)


def _bound(f: ast.FunctionDef | ast.AsyncFunctionDef) -> dict:
    both = list(zip(parameters(f.args), default_texts(f.args), strict=True))
    both = both[1:] if both and both[0][0]["name"] in ("self", "cls") else both
    return {"params": [p for p, _ in both], "defaults": [d for _, d in both]}


def file_facts(module: str, text: str | None, segments: bool = False) -> Iterator[tuple[str, str, dict]]:
    """(kind, name, data) of one file; a file that can't be parsed says so beside its module fact.

    segments: also the source of every function.
    """
    yield "module", module, {"n_lines": len((text or "").splitlines())}
    try:
        if text is None:
            raise ValueError("no text")
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        yield "unreadable", module, {"error": f"{type(e).__name__}: {e}"[:200]}
        return
    keys: dict[tuple[str, str], int] = {}
    outer = {id(node) for node in tree.body}
    lines = [line.encode() for line in re.split(r"(?<=\n)|(?<=\r)(?!\n)", text)] if segments else []
    for node, runs in _walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            yield "function", node.name, _function_facts(node)
            if segments:
                yield "segment", node.name, {"lineno": node.lineno, "text": _segment(lines, node)}
            for p, data in _parameter_use(node):
                yield "param", p, data
        elif isinstance(node, ast.ClassDef):
            yield "class", node.name, _class_facts(node) | {"top_level": id(node) in outer}
        elif isinstance(node, ast.Import):
            for a in node.names:
                yield "import", a.name.split(".")[0], {"target": a.name, "level": 0, "symbol": None, "runtime": runs}
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                yield "import", (node.module or "").split(".")[0], {"target": node.module or "", "level": node.level, "symbol": a.name, "runtime": runs}
        elif isinstance(node, ast.Constant) and type(node.value) in (str, int, float):
            yield "literal", "", {"lit_type": type(node.value).__name__, "lit_repr": str(node.value)}
        elif isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
            at = (node.value.id, node.slice.value)
            keys[at] = keys.get(at, 0) + 1
    for (name, key), n in sorted(keys.items()):
        yield "key", name, {"key": key, "n": n}
    listed = [s.value for s in tree.body if isinstance(s, ast.Assign) and any(_name(t) == "__all__" for t in s.targets)]
    shown = {e.value for v in listed if isinstance(v, ast.List | ast.Tuple) for e in v.elts if isinstance(e, ast.Constant)} if listed else None
    if any(part.startswith("_") for part in module.split(".")):
        return
    for s in tree.body:
        if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and (s.name in shown if shown is not None else not s.name.startswith("_")):
            for name, data in _surface_of(s):
                yield "surface", f"{module}.{name}", data


#: Facts, and characters of their details, that go to Spark together.
FRAME_ROWS, FRAME_CHARS = 20_000, 4_000_000
COLUMNS = ["state", "path", "module", "kind", "name", "data"]


def frames(batches: Iterator[pd.DataFrame], segments: bool = False) -> Iterator[pd.DataFrame]:
    """Facts of files (state, path, module, text), many files to a frame: a frame for each would cost more than the parse."""
    rows: list[tuple] = []
    chars = 0
    for pdf in batches:
        for state, path, module, text in pdf.itertuples(index=False):
            for kind, name, data in file_facts(module, text, segments):
                rows.append((state, path, module, kind, name, json.dumps(data)))
                chars += len(rows[-1][-1])
            if len(rows) >= FRAME_ROWS or chars >= FRAME_CHARS:
                yield pd.DataFrame(rows, columns=COLUMNS)
                rows, chars = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=COLUMNS)


def extract(files: DataFrame, segments: bool = False) -> DataFrame:
    """All facts of (state, path, module, text), written once; see `view` for typed tables."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(10_000)
        yield from frames(batches, segments)

    schema = ", ".join(f"{c} string" for c in COLUMNS)
    return written(files.select("state", "path", "module", "text").mapInPandas(run, schema))


def view(facts: DataFrame, kind: str) -> DataFrame:
    """(state, path, module, name, ...) of one kind."""
    return facts.where(F.col("kind") == kind).withColumn("d", F.from_json("data", f"struct<{FIELDS[kind]}>")).select("state", "path", "module", "name", "d.*")


def functions(facts: DataFrame, least: int = LEAST_TOKENS) -> DataFrame:
    """Functions with enough tokens, special names left out; qualname is module and name."""
    f = view(facts, "function").where(~F.col("name").rlike("^__.*__$") & (F.size("tokens") >= least))
    return f.withColumn("qualname", F.concat_ws(".", F.when(F.col("module") != "", F.col("module")), "name"))


def _full(package: str):
    return lambda m: F.concat_ws(".", F.lit(package), F.when(m != "", m))


def _targets(facts: DataFrame, package: str) -> tuple[DataFrame, F.Column]:
    """Imports (state, src, target, symbol, ...), and their absolute target."""
    i = view(facts, "import").select("state", _full(package)(F.col("module")).alias("src"), "target", "level", "symbol")
    parts = F.split("src", r"\.")
    base = F.concat_ws(".", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.col("level"), F.lit(0))))
    return i, F.when(F.col("level") > 0, F.concat_ws(".", F.when(base != "", base), F.when(F.col("target") != "", F.col("target")))).otherwise(F.col("target"))


def _resolved(each: DataFrame, facts: DataFrame, package: str) -> DataFrame:
    """(state, src, t, dst): the longest prefix of t that is a module of the tree; others are left out."""
    named = each.select("state", "src", "t").distinct()
    steps = named.withColumn("p", F.split("t", r"\.")).withColumn("n", F.explode(F.sequence(F.lit(1), F.size("p"))))
    prefixes = steps.select("state", "src", "t", "n", F.concat_ws(".", F.slice("p", F.lit(1), F.col("n"))).alias("dst"))
    modules = facts.select("state", _full(package)(F.col("module")).alias("dst")).distinct()
    return prefixes.join(modules, ["state", "dst"]).groupBy("state", "src", "t").agg(F.max_by("dst", "n").alias("dst"))


def import_strength(facts: DataFrame, package: str) -> DataFrame:
    """(state, src, dst, strength) among a tree's modules, with the package's name before them; strength counts the imports.

    Absolute targets go to their longest prefix that is a module; relative ones
    climb from the importing module; an imported name is also tried as a module.
    """
    i, target = _targets(facts, package)
    tried = F.array_distinct(F.array_compact(F.array(target, F.when(F.col("symbol").isNotNull(), F.concat_ws(".", target, "symbol")))))
    each = i.select("state", "src", F.explode(tried).alias("t")).groupBy("state", "src", "t").agg(F.count("*").alias("n"))
    found = each.join(_resolved(each, facts, package), ["state", "src", "t"])
    return found.where("src != dst").groupBy("state", "src", "dst").agg(F.sum("n").alias("strength"))


def import_edges(facts: DataFrame, package: str) -> DataFrame:
    """(state, src, dst): the edges of `import_strength`, each once."""
    return import_strength(facts, package).select("state", "src", "dst")


def imported_symbols(facts: DataFrame, package: str) -> DataFrame:
    """(state, src, home, symbol): what modules take from the tree's others; symbol is null for a whole module."""
    i, target = _targets(facts, package)
    each = i.select("state", "src", target.alias("t"), "symbol").distinct()
    found = each.join(_resolved(each, facts, package), ["state", "src", "t"])
    return found.where("src != dst").select("state", "src", F.col("dst").alias("home"), "symbol").distinct()


def bare_edges(facts: DataFrame) -> DataFrame:
    """(state, src, dst): imports whose target, as written, is a module's path below the root; levels don't count."""
    i = view(facts, "import").select("state", F.col("module").alias("src"), F.col("target").alias("dst")).where("dst != '' and src != dst").distinct()
    return i.join(facts.select("state", F.col("module").alias("dst")).distinct(), ["state", "dst"], "left_semi").select("state", "src", "dst")


def bare_coupling(facts: DataFrame) -> DataFrame:
    """(state, total_internal_edges, max_module_fanout) over `bare_edges`."""
    fan = bare_edges(facts).groupBy("state", "src").agg(F.count("*").alias("n")).groupBy("state").agg(F.sum("n").alias("total_internal_edges"), F.max("n").alias("max_module_fanout"))
    return facts.select("state").distinct().join(fan, "state", "left").na.fill(0)


def third_party(facts: DataFrame, package: str) -> DataFrame:
    """(state, module, top): outside packages that a module imports when it runs; the root module is `__init__`.

    Relative imports, the tree's own package, the standard library and imports
    for type checkers only are left out.
    """
    i = view(facts, "import").where("level = 0 and runtime").select("state", F.when(F.col("module") == "", "__init__").otherwise(F.col("module")).alias("module"), F.split("target", r"\.")[0].alias("top"))
    return i.where((F.col("top") != "") & (F.col("top") != package) & ~F.col("top").isin(*sorted(sys.stdlib_module_names))).distinct()


def class_homes(facts: DataFrame) -> DataFrame:
    """(state, name, module) of the outermost classes whose name one module alone defines."""
    c = view(facts, "class").where("top_level").select("state", "name", "module").distinct()
    return c.groupBy("state", "name").agg(F.min("module").alias("module"), F.count("*").alias("n")).where("n = 1").drop("n")


# Ends of class names and starts of function names that tell of a translation.
SEAM_CLASSES = ("adapter", "wrapper", "codec", "translator", "mapper")
SEAM_FUNCTIONS = ("to_", "from_", "adapt", "convert")


def translation_seams(facts: DataFrame) -> DataFrame:
    """(state, module) of the modules that hold a class or function whose name tells of a translation."""
    name = F.lower("name")
    own = ((F.col("kind") == "class") & F.regexp_replace(name, "s+$", "").rlike(f"({'|'.join(SEAM_CLASSES)})$")) | (
        (F.col("kind") == "function") & name.rlike(f"^({'|'.join(SEAM_FUNCTIONS)})")
    )
    return facts.where(own).select("state", "module").distinct()


def changed_functions(facts: DataFrame, paths: list[str], least: int = LEAST_TOKENS) -> DataFrame:
    """The functions of `functions` in the files of a change set (paths, whole or from the root on)."""
    fits = F.lit(False)
    for p in paths:
        fits = fits | (F.col("path") == p) | F.col("path").endswith("/" + p.lstrip("/"))
    return functions(facts.where(fits), least)
