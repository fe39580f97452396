"""Syntax facts: the one step that needs a Python worker.

Source text goes in, arrays of small structs come out. All rules read the
arrays with column expressions; a file is parsed once, whatever rules run.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetlint.model import FIT_CALLS, SPLIT_CALL, TRANSFORM_CALLS
from fleetlint.session import spread

_KWARG = "struct<name:string,value_src:string,is_true:boolean>"
FACT_TYPES = {
    "calls": "array<struct<call_id:int,line:int,span:string,func_kind:string,func_name:string,"
             f"recv_name:string,n_args:int,arg0_src:string,call_src:string,kwargs:array<{_KWARG}>>>",
    "scopes": "array<struct<scope_id:int,kind:string,line:int,uses_pipeline:boolean,"
              "calls:array<struct<call_id:int,line:int,span:string,func_kind:string,func_name:string,"
              "call_src:string,item_idx:int,walk_idx:int,in_body:boolean>>>>",
    "imports": "array<struct<line:int,kind:string,module:string,level:int,names:array<string>,src:string>>",
    "defs": "array<struct<kind:string,name:string,line:int,has_docstring:boolean,typed_args:boolean,"
            "typed_return:boolean,mutable_defaults:int,complexity:int,asserts_or_calls:int>>",
    "handlers": "array<struct<line:int,body_len:int,first_stmt:string>>",
    "fstrings": "array<struct<line:int,span:string,const_text:string>>",
}
PARSE_COLUMNS = "parse_ok boolean, error_line int, error_text string"

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith)
_MARKED = frozenset((
    ast.Call, ast.Assert, ast.BoolOp, ast.ClassDef, ast.Import, ast.ImportFrom, ast.JoinedStr,
    *_FUNCTIONS, *_BRANCHES,
))
# Fields that never hold a node a rule looks at.
_LEAF_FIELDS = frozenset((
    "ctx", "op", "ops", "id", "attr", "kind", "type_comment", "level", "module", "is_async", "simple", "conversion",
))
_CHILD_FIELDS = {
    kind: tuple(f for f in kind._fields if f not in _LEAF_FIELDS)
    for kind in vars(ast).values() if isinstance(kind, type) and issubclass(kind, ast.AST)
}
_PROTOCOL = frozenset(FIT_CALLS + TRANSFORM_CALLS)


def split_text(text: str) -> list[str]:
    """Lines by newline only; a final newline opens no further line."""
    if not text:
        return []
    parts = text.split("\n")
    return parts[:-1] if parts[-1] == "" else parts


def compile_error(tree):
    """Line and message of what only the compiler objects to, or two Nones."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(tree, "<source>", "exec")
        return None, None
    except SyntaxError as err:
        return err.lineno, err.msg
    except Exception as err:  # whatever one text provokes stays with its file
        return None, f"{type(err).__name__}: {err}"


def parse_source(text: str, compiled: bool = False):
    """Tree, or None with line and message of the error."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except SyntaxError as err:
        return None, err.lineno, err.msg
    except Exception as err:
        return None, None, f"{type(err).__name__}: {err}"
    line, message = compile_error(tree) if compiled else (None, None)
    return (tree, None, None) if message is None else (None, line, message)


def _breadth_first(tree):
    """Nodes in the order of ``ast.walk`` without contexts and operators, the
    position of each one's parent, and the positions of the marked kinds."""
    nodes, parents, marked = [tree], [-1], []
    for position, node in enumerate(nodes):  # the list grows as it is read
        kind = node.__class__
        if kind in _MARKED:
            marked.append(position)
        for name in _CHILD_FIELDS[kind]:
            value = getattr(node, name, None)
            if value.__class__ is list:
                for child in value:
                    if isinstance(child, ast.AST):
                        nodes.append(child)
                        parents.append(position)
            elif isinstance(value, ast.AST):
                nodes.append(value)
                parents.append(position)
    return nodes, parents, marked


class _Errors(list):
    """What could not be told of one file; the other facts stay."""

    def source_of(self, node) -> str | None:
        """Source text of a node, or None if it cannot be written (too deep, too long a number)."""
        try:
            return ast.unparse(node)
        except Exception as err:
            self.append(f"line {getattr(node, 'lineno', 0)}: {type(err).__name__}")
            return None

    def guard(self, where: str, build, otherwise):
        try:
            return build()
        except Exception as err:
            self.append(f"{where}: {type(err).__name__}")
            return otherwise


def valid_text(value):
    """The same value with every string (lone surrogates and all) as valid UTF-8."""
    if isinstance(value, str):
        return value if value.isascii() else value.encode("utf-8", "replace").decode()
    if isinstance(value, list):
        return [valid_text(v) for v in value]
    if isinstance(value, dict):
        return {k: valid_text(v) for k, v in value.items()}
    return value


def _array_of(values: list, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:  # a literal held a lone surrogate
        return pa.array([valid_text(v) for v in values], kind)


def _span(node) -> str:
    return f"{node.col_offset}-{node.end_lineno}:{node.end_col_offset}"


def _call_fact(call_id: int, node: ast.Call, errors: _Errors) -> dict:
    kind, name, receiver = "other", None, None
    if isinstance(node.func, ast.Name):
        kind, name = "name", node.func.id
    elif isinstance(node.func, ast.Attribute):
        kind, name = "attr", node.func.attr
        if isinstance(node.func.value, ast.Name):
            receiver = node.func.value.id
    protocol = kind == "attr" and name in _PROTOCOL
    return {
        "call_id": call_id,
        "line": node.lineno,
        "span": _span(node),
        "func_kind": kind,
        "func_name": name,
        "recv_name": receiver,
        "n_args": len(node.args),
        # Source text is kept for estimator calls only; for all calls it
        # would outgrow the file itself.
        "arg0_src": errors.source_of(node.args[0]) if protocol and node.args else None,
        "call_src": errors.source_of(node) if protocol else None,
        "kwargs": [
            {
                "name": kw.arg,
                "value_src": errors.source_of(kw.value) if kw.arg == "Loader" else None,
                "is_true": isinstance(kw.value, ast.Constant) and kw.value.value is True,
            }
            for kw in node.keywords
        ],
    }


def _scope_facts(nodes, parents, calls_at, all_calls, errors) -> list[dict]:
    """Scopes that contain estimator or split calls, each with those calls.
    ``calls_at`` holds the facts of named calls, ``all_calls`` every position."""
    wanted = {
        i: c for i, c in calls_at.items()
        if (c["func_kind"] == "attr" and c["func_name"] in _PROTOCOL)
        or (c["func_kind"] == "name" and c["func_name"] == SPLIT_CALL)
    }
    if not wanted:
        return []
    scopes: dict[int, dict] = {}
    slots: dict[int, dict[int, int]] = {}

    def scope_chain(i):
        """(scope position, child position below it) for every enclosing scope."""
        child, up = i, parents[i]
        while up >= 0:
            if isinstance(nodes[up], (ast.Module, *_FUNCTIONS)):
                yield up, child
            child, up = up, parents[up]

    for i, call in wanted.items():
        for at, child in scope_chain(i):
            node = nodes[at]
            if at not in scopes:
                kind = {ast.Module: "module", ast.FunctionDef: "function"}.get(type(node), "async")
                scopes[at] = {
                    "scope_id": at, "kind": kind, "line": getattr(node, "lineno", 1),
                    "uses_pipeline": None, "calls": [],
                }
                slots[at] = {id(stmt): k for k, stmt in enumerate(node.body)}
            slot = slots[at].get(id(nodes[child]))
            scopes[at]["calls"].append({
                "call_id": call["call_id"], "line": call["line"], "span": call["span"],
                "func_kind": call["func_kind"], "func_name": call["func_name"],
                "call_src": call["call_src"], "item_idx": slot, "walk_idx": i, "in_body": slot is not None,
            })

    names = {c["func_name"] for c in wanted.values()}
    if "fit" in names and names & set(TRANSFORM_CALLS):
        for scope in scopes.values():
            scope["uses_pipeline"] = False
        for i in all_calls:
            up = parents[i]
            while up >= 0 and not isinstance(nodes[up], ast.Call):
                up = parents[up]
            # The text of an outermost call contains that of the calls in it.
            if up < 0 and "ipeline" in (text := errors.source_of(nodes[i]) or ""):
                if "Pipeline" in text or "make_pipeline" in text:
                    for at, _ in scope_chain(i):
                        if at in scopes:
                            scopes[at]["uses_pipeline"] = True
    return [scopes[k] for k in sorted(scopes)]


def _def_fact(node, complexity: int, checks: int) -> dict:
    is_class = isinstance(node, ast.ClassDef)
    args = [] if is_class else node.args.args
    defaults = [] if is_class else node.args.defaults
    return {
        "kind": "class" if is_class else "async" if isinstance(node, ast.AsyncFunctionDef) else "function",
        "name": node.name,
        "line": node.lineno,
        "has_docstring": bool(ast.get_docstring(node)),
        "typed_args": any(a.annotation is not None for a in args if a.arg != "self"),
        "typed_return": not is_class and node.returns is not None,
        "mutable_defaults": sum(isinstance(d, (ast.List, ast.Dict, ast.Set)) for d in defaults),
        "complexity": complexity,
        "asserts_or_calls": checks,
    }


def facts_of(tree, call_names: frozenset | None, want: frozenset, errors: _Errors) -> dict:
    """Fact arrays of one parsed file; ``call_names`` limits the call list.

    A fact that cannot be told is left out and noted in ``errors``.
    """
    nodes, parents, marked = _breadth_first(tree)
    out: dict = {name: [] for name in want}
    if call_names is not None and "scopes" in want:
        call_names = call_names | _PROTOCOL | {SPLIT_CALL}
    branches = [0] * len(nodes)
    checks = [0] * len(nodes)
    calls_at: dict[int, dict] = {}
    defs_at: list[int] = []
    n_calls = 0
    for i in marked:
        node = nodes[i]
        if isinstance(node, ast.Call):
            checks[i] = 1
            func = node.func
            name = func.id if isinstance(func, ast.Name) else getattr(func, "attr", None)
            if call_names is None or name in call_names:
                fact = errors.guard(f"line {node.lineno}", lambda: _call_fact(n_calls, node, errors), None)
                if fact is not None:
                    calls_at[i] = fact
            n_calls += 1
        elif isinstance(node, ast.Assert):
            checks[i] = 1
        elif isinstance(node, _BRANCHES):
            branches[i] = 1
            if isinstance(node, ast.ExceptHandler) and "handlers" in want:
                first = node.body[0]
                label = {ast.Pass: "pass", ast.Continue: "continue"}.get(type(first), "other")
                out["handlers"].append({"line": node.lineno, "body_len": len(node.body), "first_stmt": label})
        elif isinstance(node, ast.BoolOp):
            branches[i] = len(node.values) - 1
        elif isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            defs_at.append(i)
        elif isinstance(node, (ast.Import, ast.ImportFrom)) and "imports" in want:
            plain = isinstance(node, ast.Import)
            out["imports"].append({
                "line": node.lineno, "kind": "import" if plain else "from",
                "module": None if plain else node.module, "level": 0 if plain else node.level,
                "names": [a.name for a in node.names], "src": errors.source_of(node) or "",
            })
        elif isinstance(node, ast.JoinedStr) and "fstrings" in want:
            text = "".join(p.value for p in node.values if isinstance(p, ast.Constant)).lower()
            out["fstrings"].append({"line": node.lineno, "span": _span(node), "const_text": text})
    if "defs" in want and defs_at:
        # Children come after their parents, so one backward pass sums subtrees.
        for i in range(len(nodes) - 1, 0, -1):
            branches[parents[i]] += branches[i]
            checks[parents[i]] += checks[i]
        made = (errors.guard("definition", lambda: _def_fact(nodes[i], 1 + branches[i], checks[i]), None) for i in defs_at)
        out["defs"] = [d for d in made if d is not None]
    if "calls" in want:
        out["calls"] = list(calls_at.values())
    if "scopes" in want:
        every = [i for i in marked if isinstance(nodes[i], ast.Call)]
        out["scopes"] = errors.guard("scopes", lambda: _scope_facts(nodes, parents, calls_at, every, errors), [])
    return out


def extract_facts(
    files: DataFrame, want=tuple(FACT_TYPES), call_names=None,
    with_lines: bool = False, compiled: bool = False,
) -> DataFrame:
    """Add parse state, the wanted fact arrays and, on request, the lines.

    ``content`` is replaced; every other column is passed through. Rows that
    are not Python pass with empty facts, rows without content with nulls.
    ``compiled`` also reports errors that only the compiler finds (a stray
    ``return``, say) as parse errors.
    """
    spark = files.sparkSession
    kept = [c for c in files.columns if c != "content"]
    ddl = ", ".join(
        [PARSE_COLUMNS, "fact_errors array<string>"] + (["lines array<string>"] if with_lines else [])
        + [f"{name} {FACT_TYPES[name]}" for name in want]
    )
    added = T._parse_datatype_string(ddl)
    schema = T.StructType([files.schema[c] for c in kept] + added.fields)
    arrow = to_arrow_schema(schema)
    wanted = frozenset(want)
    names = None if call_names is None else frozenset(call_names)
    new_columns = [f.name for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {c: [] for c in new_columns}
            texts = batch.column("content").to_pylist()
            flags = batch.column("is_python").to_pylist()
            for text, is_python in zip(texts, flags):
                row: dict = {}
                if with_lines:
                    row["lines"] = None if text is None else split_text(text)
                if is_python and text is not None:
                    tree, line, message = parse_source(text, compiled)
                    row.update(parse_ok=tree is not None, error_line=line, error_text=message)
                    if tree is not None:
                        errors = _Errors()
                        row.update(errors.guard("file", lambda: facts_of(tree, names, wanted, errors), {}))
                        row["fact_errors"] = list(errors)
                for c in new_columns:
                    columns[c].append(row.get(c, [] if c in wanted else None))
            arrays = [batch.column(c) for c in kept]
            arrays += [_array_of(columns[c], arrow.field(c).type) for c in new_columns]
            yield pa.RecordBatch.from_arrays(
                [a.cast(arrow.field(k).type) if a.type != arrow.field(k).type else a
                 for k, a in enumerate(arrays)],
                names=arrow.names,
            )

    return spread(files, "repo_id", "path").mapInArrow(run, schema)


def fact_view(facts: DataFrame, name: str) -> DataFrame:
    """One row per fact of an array column."""
    return facts.select("repo_id", "path", F.inline(name))


def scope_call_view(facts: DataFrame) -> DataFrame:
    """One row per (scope, call), the flat form of ``scopes``."""
    scope = facts.select("repo_id", "path", F.explode("scopes").alias("s"))
    return scope.select(
        "repo_id", "path", F.col("s.scope_id"), F.col("s.kind").alias("scope_kind"),
        F.col("s.line").alias("scope_line"), F.col("s.uses_pipeline"), F.explode("s.calls").alias("c"),
    ).select(
        "repo_id", "path", "scope_id", "scope_kind", "scope_line", "uses_pipeline",
        F.col("c.call_id"), F.col("c.line"), F.col("c.func_name"), F.col("c.item_idx"),
        F.col("c.walk_idx"), F.col("c.in_body"),
    )
