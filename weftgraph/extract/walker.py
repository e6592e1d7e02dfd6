"""One Python source to extraction records.

A record is a dict with ``record`` (node, edge, statement, variable, evidence, argument, param or error) and the fields
that apply.  A file is parsed once; names are qualified by its module.  Only what a file itself shows is resolved
here (methods of the own class, annotated or constructed locals, imports, nested and module-level names); joins across
files are made on tables.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from weftgraph.functions import identity
from weftgraph.functions.identity import children_of, nodes_of, statements_of

#: Methods that change their receiver.
MUTATORS = (
    "acquire", "add", "append", "clear", "difference_update", "discard", "extend", "insert", "intersection_update", "pop", "popitem",
    "release", "remove", "reverse", "setdefault", "sort", "symmetric_difference_update", "truncate", "update", "write", "writelines",
)

#: Kinds of records.
KINDS = ("node", "edge", "statement", "variable", "evidence", "argument", "param", "error")
Def = (ast.FunctionDef, ast.AsyncFunctionDef)
Record = dict[str, object]


def module_name(path: str) -> str:
    """Dotted name of a relative path; ``__init__`` stays."""
    return path.removesuffix(".py").strip("/").replace("/", ".")


def access(name: str) -> str:
    return "private" if name.startswith("__") and not name.endswith("__") else "protected" if name.startswith("_") and not name.startswith("__") else "public"


@dataclass
class _Scope:
    """What a function's body knows."""

    name: str
    owner: str | None  # class
    known: dict[str, str] = field(default_factory=dict)  # raw name -> variable
    types: dict[str, str] = field(default_factory=dict)  # raw name -> class
    order: int = 0


class Walker:
    """Walks one file; with ``kinds`` for records of these kinds only, without ``bodies`` for definitions and imports only."""

    def __init__(self, path: str, source: str, package: str | None = None, kinds: Sequence[str] = (), bodies: bool = True) -> None:
        self.path, self.source = path, source
        self.kinds, self.bodies = frozenset(kinds or KINDS), bodies
        #: Whether anything tells of what statements do, beyond that they are there.
        self.uses = not self.kinds.isdisjoint(("edge", "variable", "evidence", "argument"))
        self.module = package or module_name(path)
        self.out: list[Record] = []
        self.imports: dict[str, str] = {}
        self.defined: dict[str, str] = {}
        self.attributes: dict[str, dict[str, str]] = {}  # class -> attribute -> annotation
        self.variables: dict[str, Record] = {}
        self.walk_order = 0
        self.rows = source.split("\n")
        # lines as the parser tells them; places within one are counted in bytes
        self._lines = [line.encode("utf-8", "surrogatepass") for line in re.findall(r"[^\r\n]*(?:\r\n|\n|\r|\Z)", source)]

    def run(self) -> list[Record]:
        try:
            tree = ast.parse(self.source)
        except (SyntaxError, ValueError, RecursionError) as e:
            return [{"record": "error", "name": self.module, "text": f"{type(e).__name__}: {e}"}] if "error" in self.kinds else []
        lines = self.source.count("\n") + 1
        self._emit("node", label="Module", kind="module", name=self.module, start_line=1, end_line=lines, docstring=ast.get_docstring(tree), checksum=identity.sha256(self.source))
        self._imports(tree)
        self._names(tree.body, self.module)
        self._definitions(tree.body, self.module, "Module", None)
        return self.out

    def _emit(self, record: str, **fields: object) -> None:
        if record in self.kinds:
            self.out.append({"record": record, "module": self.module, **fields})

    def _edge(self, kind: str, src: str, dst: str, **fields: object) -> None:
        self._emit("edge", type=kind, src=src, dst=dst, **fields)

    def _text(self, node: ast.AST) -> str:
        """The node's segment of the source; ``ast.get_source_segment`` would split the whole source for each node."""
        first, last = node.lineno - 1, node.end_lineno - 1
        if first == last:
            part = self._lines[first][node.col_offset : node.end_col_offset]
        else:
            part = b"".join([self._lines[first][node.col_offset :], *self._lines[first + 1 : last], self._lines[last][: node.end_col_offset]])
        return part.decode() or ast.unparse(node)

    # --- names of the file

    def _imports(self, tree: ast.Module) -> None:
        package = self.module.split(".")
        for node in statements_of(tree):
            if isinstance(node, ast.Import):
                for a in node.names:
                    self.imports[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
                    self._edge("IMPORTS", self.module, a.name, alias=a.asname, line=node.lineno)
            elif isinstance(node, ast.ImportFrom):
                base = package[: len(package) - node.level] if node.level else []
                target = ".".join([*base, *([node.module] if node.module else [])])
                self._edge("IMPORTS", self.module, target, line=node.lineno)
                for a in node.names:
                    if a.name != "*":
                        self.imports[a.asname or a.name] = f"{target}.{a.name}" if target else a.name
                        self._edge("IMPORTS", self.module, self.imports[a.asname or a.name], alias=a.asname, line=node.lineno)

    def _names(self, body: list[ast.stmt], prefix: str) -> None:
        for node in body:
            if isinstance(node, (*Def, ast.ClassDef)):
                name = f"{prefix}.{node.name}"
                self.defined[name] = name
                self.defined.setdefault(node.name, name)  # the first of a short name wins
                if isinstance(node, ast.ClassDef):
                    self.attributes[name] = _annotations(node)
                self._names(node.body, name)

    # --- definitions

    def _definitions(self, body: list[ast.stmt], parent: str, parent_label: str, owner: str | None) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef):
                self._class(node, parent)
            elif isinstance(node, Def):
                self._function(node, parent, owner if parent_label == "Class" else None)
            elif parent_label == "Module" and hasattr(node, "body"):  # under if or try at the top
                self._definitions([n for n in ast.iter_child_nodes(node) if isinstance(n, (ast.stmt))], parent, parent_label, owner)

    def _common(self, node: ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) -> Record:
        text = self._text(node)
        return {
            "start_line": node.lineno, "end_line": node.end_lineno, "start_col": node.col_offset, "end_col": node.end_col_offset, "text": text, "docstring": ast.get_docstring(node),
            "decorators": [ast.unparse(d) for d in node.decorator_list], "signature": identity.signature_of(node),
        }

    def _class(self, node: ast.ClassDef, parent: str) -> None:
        name = f"{parent}.{node.name}"
        self._emit("node", label="Class", kind="class", name=name, parent=parent, **self._common(node))
        self._edge("DEFINES", parent, name)
        for base in node.bases:
            raw = ast.unparse(base).split("[")[0]
            self._edge("INHERITS", name, self._resolve(raw, None), line=node.lineno)
        for n in node.body:  # attributes of the class itself
            if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name):
                self._variable(f"{name}.{n.target.id}", name, name, n.lineno, hint=ast.unparse(n.annotation), attribute=True)
        self._definitions(node.body, name, "Class", name)

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef, parent: str, owner: str | None) -> None:
        name = f"{parent}.{node.name}"
        listed = identity.params_of(node)
        self._emit("node", label="Function", kind="method" if owner else "function", name=name, parent=parent, is_async=isinstance(node, ast.AsyncFunctionDef), params=listed, return_type=ast.unparse(node.returns) if node.returns else None, **self._common(node))
        self._edge("DEFINES", parent, name)
        if owner:
            self._edge("MEMBER_OF", name, owner, access=access(node.name))
        scope = _Scope(name, owner)
        for i, p in enumerate(listed):
            variable = self._variable(f"{name}.{p['name']}", name, name, node.lineno, hint=p["type_hint"], parameter=True)
            scope.known[str(p["name"])] = variable
            self._emit("param", callee=name, position=i, name=p["name"], variable=variable, keyword=p["kind"])
            if p["type_hint"]:
                scope.types[str(p["name"])] = self._resolve(_plain(str(p["type_hint"])), owner)
        if self.bodies:
            _Body(self, scope).run(node)
        self._definitions(node.body, name, "Function", None)

    def _variable(self, name: str, scope: str, function: str, line: int, *, hint: object = None, parameter: bool = False, attribute: bool = False) -> str:
        old = self.variables.get(name)
        if old is None:
            row = {"record": "variable", "module": self.module, "name": name, "scope": scope, "origin_line": line, "origin_func": function, "type_hint": hint, "is_parameter": parameter, "is_attribute": attribute}
            self.variables[name] = row
            if "variable" in self.kinds:
                self.out.append(row)
        elif hint and not old["type_hint"]:
            old["type_hint"] = hint
        return name

    # --- resolution

    def _resolve(self, raw: str, owner: str | None, types: dict[str, str] | None = None, function: str | None = None) -> str:
        """The qualified name of a callee or base: own class, typed local, import, nested, module-level; else as it stands."""
        head, _, rest = raw.partition(".")
        known = owner if head in ("self", "cls") else (types or {}).get(head)
        if rest and known:
            attribute, _, more = rest.partition(".")
            hint = self.attributes.get(known, {}).get(attribute) if more else None
            return f"{self._resolve(_plain(hint), None)}.{more}" if hint else f"{known}.{rest}"
        if raw in self.imports:
            return self.imports[raw]
        if head in self.imports and rest:
            return f"{self.imports[head]}.{rest}"
        at = function
        while at and at.startswith(self.module):
            if f"{at}.{raw}" in self.defined:
                return f"{at}.{raw}"
            at = at.rpartition(".")[0]
        if head in self.defined:
            return self.defined[head] + (f".{rest}" if rest else "")
        return raw


def _plain(hint: str) -> str:
    """The class of a type hint: without quotes, brackets and None."""
    return hint.strip("'\"").replace("| None", "").replace("None |", "").removeprefix("Optional[").split("[")[0].rstrip("]").strip()


def _element(hint: str | None) -> str | None:
    """The class of what a hinted container holds."""
    inner = hint.strip("'\"").partition("[")[2].rpartition("]")[0] if hint else ""
    return _plain(inner.split(",")[-1].strip()) if inner and "[" not in inner else None


def _annotations(node: ast.ClassDef) -> dict[str, str]:
    """Annotations of a class's attributes: from its body, from self.a: T, self.a = T(...) and self.a = annotated parameter."""
    out = {n.target.id: ast.unparse(n.annotation) for n in node.body if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name)}
    for method in (n for n in node.body if isinstance(n, Def)):
        hints = {a.arg: ast.unparse(a.annotation) for a in [*method.args.posonlyargs, *method.args.args, *method.args.kwonlyargs] if a.annotation}
        for n in statements_of(method):
            target = n.targets[0] if isinstance(n, ast.Assign) and len(n.targets) == 1 else n.target if isinstance(n, ast.AnnAssign) else None
            raw = _dotted(target) if target is not None else None
            if not raw or not raw.startswith("self.") or raw.count(".") > 1:
                continue
            hint = ast.unparse(n.annotation) if isinstance(n, ast.AnnAssign) else hints.get(n.value.id) if isinstance(n.value, ast.Name) else None
            if hint is None and isinstance(n.value, ast.Call) and (made := _dotted(n.value.func)) and made.rpartition(".")[2][:1].isupper():
                hint = made
            if hint:
                out.setdefault(raw.removeprefix("self."), hint)
    return out


class _Body:
    """Statements, calls and uses of variables in one function, in the order of the source."""

    def __init__(self, walker: Walker, scope: _Scope) -> None:
        self.w, self.s = walker, scope
        self.seq = 0
        self.calls = 0

    def run(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        body = node.body[1:] if ast.get_docstring(node) is not None else node.body
        if self.w.uses:
            self._types(node)
        self._block(body, self.s.name, "Function", self.s.name, None, None)

    def _types(self, node: ast.AST) -> None:
        nodes = nodes_of(node)
        for n in nodes:
            if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
                name = self.w._resolve(ast.unparse(n.value.func), self.s.owner, None, self.s.name)
                if name.rpartition(".")[2][:1].isupper():
                    self.s.types[n.targets[0].id] = name
            elif isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name):
                self.s.types[n.target.id] = self.w._resolve(_plain(ast.unparse(n.annotation)), self.s.owner)
        for n in nodes:
            if isinstance(n, (ast.For, ast.AsyncFor, ast.comprehension)) and isinstance(n.target, ast.Name):
                held = _element(self._hint(_dotted(n.iter), node))
                if held:
                    self.s.types.setdefault(n.target.id, self.w._resolve(held, self.s.owner))

    def _hint(self, raw: str | None, node: ast.FunctionDef | ast.AsyncFunctionDef) -> str | None:
        """The annotation of a parameter, or of an attribute of self or of a typed name."""
        if raw is None:
            return None
        head, _, rest = raw.partition(".")
        if rest:
            return self.w.attributes.get(self.s.owner if head == "self" else self.s.types.get(head, ""), {}).get(rest)
        return next((ast.unparse(a.annotation) for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs] if a.arg == raw and a.annotation), None)

    # --- statements

    def _block(self, body: list[ast.stmt], parent: str, label: str, prefix: str, context: str | None, branch: str | None) -> None:
        last, place = None, 0
        for node in body:
            if isinstance(node, (*Def, ast.ClassDef)):
                continue
            kind = _KINDS.get(type(node))
            name = None
            if kind is not None:
                control = isinstance(node, _CONTROL)
                name = f"{prefix}.{'cf' if control else 'stmt'}_{place}"
                self.w._emit("statement", label="ControlFlow" if control else "Statement", name=name, kind=kind, text=self.w._text(node).split("\n")[0] if control else self.w._text(node), condition=_condition(node) if control else None, start_line=node.lineno, end_line=node.end_lineno, start_col=node.col_offset, end_col=node.end_col_offset, seq=place, parent=parent)
                self.w._edge("CONTAINS", parent, name, seq=place)
                if last:
                    self.w._edge("NEXT", last, name)
                last = name
            place += 1
            self._statement(node, name, context, branch)
            self.seq += 1

    def _branch(self, control: str | None, kind: str, number: int, body: list[ast.stmt], condition: str | None, outer: str | None = None) -> None:
        if not control:
            self._block(body, self.s.name, "Function", f"{self.s.name}.block_{self.seq}", condition, kind)
            return
        name = f"{control}.branch_{number}"
        self.w._emit("statement", label="Branch", name=name, kind=kind, condition=condition, start_line=body[0].lineno if body else None, end_line=body[-1].end_lineno if body else None, seq=number, parent=control)
        self.w._edge("CONTAINS", control, name, seq=number)
        self._block(body, name, "Branch", name, condition if condition is not None else outer, kind)

    def _statement(self, node: ast.stmt, name: str | None, context: str | None, branch: str | None) -> None:
        place = {"line": node.lineno, "seq": self.seq, "control_context": context, "branch": branch}
        if isinstance(node, ast.If):
            number, at = 0, node
            while True:
                kind = "if" if number == 0 else "elif"
                self._expression(at.test, {**place, "line": at.lineno})
                self._branch(name, kind, number, at.body, ast.unparse(at.test))
                number += 1
                if len(at.orelse) == 1 and isinstance(at.orelse[0], ast.If) and self.w.rows[at.orelse[0].lineno - 1].lstrip().startswith("elif"):
                    at = at.orelse[0]
                    continue
                if at.orelse:
                    self._branch(name, "else", number, at.orelse, None, ast.unparse(node.test))
                return
        if isinstance(node, (ast.For, ast.AsyncFor)):
            self._calls(node.iter)
            for raw in _targets(node.target):
                self._assign(raw, {**place, "seq": node.lineno - 1}, rebind=False)
            self._branch(name, "for", 0, node.body, _condition(node))
            if node.orelse:
                self._branch(name, "else", 1, node.orelse, None)
        elif isinstance(node, ast.While):
            self._expression(node.test, place)
            self._branch(name, "while", 0, node.body, ast.unparse(node.test))
            if node.orelse:
                self._branch(name, "else", 1, node.orelse, None)
        elif isinstance(node, (ast.Try, ast.TryStar)):
            parts = [("try", node.body, None), *(("except", h.body, ast.unparse(h.type) if h.type else None) for h in node.handlers), ("else", node.orelse, None), ("finally", node.finalbody, None)]
            for number, (kind, body, condition) in enumerate([p for p in parts if p[1]]):
                self._branch(name, kind, number, body, condition, context)
        elif isinstance(node, (ast.With, ast.AsyncWith)):
            for item in node.items:
                self._calls(item.context_expr)
                for raw in _targets(item.optional_vars) if item.optional_vars else []:
                    self._assign(raw, place)
            self._branch(name, "with", 0, node.body, _condition(node))
        elif isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            self._assignment(node, place)
        elif isinstance(node, ast.Return):
            if node.value is not None:
                self._calls(node.value)
                for raw in _used(node.value):
                    self._use("RETURNS", raw, place)
        elif isinstance(node, ast.Expr):
            self._expression(node.value, place)
        else:
            for n in ast.iter_child_nodes(node):
                if isinstance(n, ast.expr):
                    self._calls(n)
                elif isinstance(n, ast.match_case):
                    self._block(n.body, self.s.name, "Function", f"{self.s.name}.case_{self.seq}", None, None)

    def _assignment(self, node: ast.Assign | ast.AnnAssign | ast.AugAssign, place: Record) -> None:
        if not self.w.uses:
            return
        if node.value is not None:
            self._expression(node.value, place)
        hint = ast.unparse(node.annotation) if isinstance(node, ast.AnnAssign) else None
        for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
            for raw in _targets(target):
                self._assign(raw, place, hint=hint)
            for n in nodes_of(target):
                if isinstance(n, ast.Subscript):
                    base = _dotted(n.value)
                    self._evidence_of(n)
                    if base:
                        self._use("MUTATES", base, place, mutation_kind="subscript_assign")
                elif isinstance(n, ast.Attribute) and isinstance(n.ctx, ast.Store) and isinstance(n.value, ast.Name) and n.value.id not in ("self", "cls"):
                    self._evidence(n.value.id, "attrs", n.attr)
                    self._use("MUTATES", n.value.id, place, mutation_kind="attr_assign")

    def _assign(self, raw: str, place: Record, *, hint: str | None = None, rebind: bool | None = None) -> None:
        attribute = raw.startswith("self.")
        if attribute and not self.s.owner:
            return
        name = f"{self.s.owner}.{raw.removeprefix('self.')}" if attribute else f"{self.s.name}.{raw}"
        seen = name in self.w.variables
        self.w._variable(name, self.s.owner if attribute else self.s.name, self.s.name, int(place["line"]), hint=hint, attribute=attribute)
        self.s.known[raw] = name
        self.w.walk_order += 1
        self.w._edge("ASSIGNS", self.s.name, name, is_rebind=seen if rebind is None else rebind, walk_order=self.w.walk_order, **place)

    # --- expressions

    def _name_of(self, raw: str) -> str | None:
        """The known variable of a raw name; ``self.a`` is the class's."""
        if raw.startswith("self.") and self.s.owner:
            name = f"{self.s.owner}.{raw.split('.')[1]}"
            return name if name in self.w.variables else None
        return self.s.known.get(raw.split(".")[0]) if raw.split(".")[0] != "self" else None

    def _use(self, kind: str, raw: str, place: Record, **fields: object) -> None:
        name = self._name_of(raw)
        if name:
            self.w.walk_order += 1
            self.w._edge(kind, self.s.name, name, walk_order=self.w.walk_order, **place, **fields)

    def _evidence(self, raw: str, facet: str, item: str) -> None:
        name = self._name_of(raw)
        if name:
            self.w._emit("evidence", variable=name, facet=facet, item=item, type_hint=self.w.variables[name]["type_hint"], function=self.s.name)

    def _evidence_of(self, node: ast.Subscript) -> None:
        base = _dotted(node.value)
        if base and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
            self._evidence(base, "subscripts", node.slice.value)

    def _expression(self, node: ast.expr, place: Record) -> None:
        """Reads, mutations and evidence of an expression, then its calls."""
        if not self.w.uses:
            return
        nodes = nodes_of(node)
        methods = {id(n.func) for n in nodes if isinstance(n, ast.Call)}
        mutated = set()
        for n in nodes:
            if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute):
                base = _dotted(n.func.value)
                if base and self._name_of(base):
                    self._evidence(base, "methods", n.func.attr)
                    if n.func.attr in MUTATORS:
                        mutated.add(base)
                        self._use("MUTATES", base, place, mutation_kind="method_call")
            elif isinstance(n, ast.Attribute) and id(n) not in methods:
                base = _dotted(n.value)
                if base and base != "self":
                    self._evidence(base, "attrs", n.attr)
            elif isinstance(n, ast.Subscript):
                self._evidence_of(n)
            elif isinstance(n, ast.NamedExpr) and isinstance(n.target, ast.Name):
                self._assign(n.target.id, place)
        for raw in _used(node):
            if raw not in mutated:
                self._use("READS", raw, place)
        if methods:
            self._calls(node)

    def _calls(self, node: ast.expr) -> None:
        if not self.w.uses:
            return
        for n in _preorder(node):
            raw = _dotted(n.func)
            if raw is None:
                continue
            callee = self.w._resolve(raw, self.s.owner, self.s.types, self.s.name)
            self.w._edge("CALLS", self.s.name, callee, call_line=n.lineno, line=n.lineno, seq=self.seq, call_order=self.calls)
            call = f"{self.s.name}#{self.calls}"
            self.calls += 1
            for position, a in enumerate(n.args):
                self._argument(call, callee, n.lineno, position, None, a)
            for k in n.keywords:
                if k.arg:
                    self._argument(call, callee, n.lineno, None, k.arg, k.value)

    def _argument(self, call: str, callee: str, line: int, position: int | None, keyword: str | None, node: ast.expr) -> None:
        raw = _dotted(node)
        name = self._name_of(raw) if raw else None
        if name:
            self.w._emit("argument", call_id=call, caller=self.s.name, callee=callee, position=position, keyword=keyword, arg=name, line=line, seq=self.seq)


_CONTROL = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.With, ast.AsyncWith)
_KINDS = {
    ast.Assign: "assignment", ast.AnnAssign: "assignment", ast.AugAssign: "augmented_assignment", ast.Expr: "expression", ast.Return: "return", ast.Raise: "raise", ast.Assert: "assert",
    ast.Delete: "delete", ast.Pass: "pass", ast.Break: "break", ast.Continue: "continue", ast.Global: "global", ast.Nonlocal: "nonlocal",
    ast.If: "if", ast.For: "for", ast.AsyncFor: "for", ast.While: "while", ast.Try: "try", ast.TryStar: "try", ast.With: "with", ast.AsyncWith: "with",
}


def _condition(node: ast.stmt) -> str | None:
    if isinstance(node, (ast.If, ast.While)):
        return ast.unparse(node.test)
    if isinstance(node, (ast.For, ast.AsyncFor)):
        return f"{ast.unparse(node.target)} in {ast.unparse(node.iter)}"
    if isinstance(node, (ast.With, ast.AsyncWith)):
        return ", ".join(ast.unparse(i) for i in node.items)
    return None


def _dotted(node: ast.AST) -> str | None:
    """a.b.c of names and attributes only."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def _targets(node: ast.AST) -> list[str]:
    """Raw names that a target binds: plain names, and attributes of self."""
    if isinstance(node, ast.Name):
        return [node.id]
    if isinstance(node, ast.Starred):
        return _targets(node.value)
    if isinstance(node, (ast.Tuple, ast.List)):
        return [t for n in node.elts for t in _targets(n)]
    if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "self":
        return [f"self.{node.attr}"]
    return []


def _used(node: ast.AST) -> list[str]:
    """Raw names that an expression loads, each once, in order; self counts with its attribute."""
    found: dict[str, None] = {}

    def visit(n: ast.AST) -> None:
        if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "self":
            found[f"self.{n.attr}"] = None
        elif isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load):
            found[n.id] = None
        else:
            for child in children_of(n):
                visit(child)

    visit(node)
    return list(found)


def _preorder(node: ast.AST) -> Iterator[ast.Call]:
    if isinstance(node, ast.Call):
        yield node
    for child in children_of(node):
        if not isinstance(child, ast.Lambda):
            yield from _preorder(child)
