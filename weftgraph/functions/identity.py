"""Identifiers and content hashes: of names as Spark columns, of Python sources as plain functions."""

from __future__ import annotations

import ast
import hashlib
import io
import keyword
import builtins
import tokenize
import uuid
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of deterministic ids.
NAMESPACE = uuid.UUID("d7e6f5a4-b3c2-1d0e-9f8a-7b6c5d4e3f2a")


def uuid5(name: Column) -> Column:
    """UUID version 5 of a name in the namespace, by built-in functions only."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.split(F.lit("8,9,a,b"), ","), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def uuid7(at: Column, random: Column | None = None) -> Column:
    """UUID version 7 of a timestamp: 48 bits of milliseconds, then random bits (32 hexadecimal digits, fresh ones by default)."""
    bits = F.replace(F.uuid(), F.lit("-"), F.lit("")) if random is None else random
    time = F.lower(F.lpad(F.hex(F.unix_millis(at)), 12, "0"))
    variant = F.element_at(F.split(F.lit("8,9,a,b"), ","), F.conv(F.substring(bits, 1, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws("-", F.substring(time, 1, 8), F.substring(time, 9, 4), F.concat(F.lit("7"), F.substring(bits, 18, 3)), F.concat(variant, F.substring(bits, 2, 3)), F.substring(bits, 21, 12))


def node_id(name: Column) -> Column:
    return uuid5(name)


def variable_id(name: Column, scope: Column) -> Column:
    return uuid5(F.concat_ws("::", name, scope))


def shape_id(shape_hash: Column) -> Column:
    return uuid5(F.concat(F.lit("typeshape::"), shape_hash))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


#: Fields that hold no part of a tree that is walked: names, operators, contexts.
_LEAVES = ("id", "attr", "ctx", "op", "ops", "type_comment", "type_ignores", "level", "conversion", "simple")
_FIELDS = {kind: tuple(f for f in kind._fields if f not in _LEAVES) for kind in vars(ast).values() if isinstance(kind, type) and issubclass(kind, ast.AST)} | {ast.Constant: ()}
#: Nodes that statements lie in.
_HOLDERS = (ast.stmt, ast.ExceptHandler, ast.match_case)


def children_of(node: ast.AST) -> list[ast.AST]:
    """As ``ast.iter_child_nodes``, in a fraction of its time, without contexts and operators."""
    found = []
    for name in _FIELDS[node.__class__]:
        value = getattr(node, name, None)
        if value.__class__ is list:
            found += [x for x in value if isinstance(x, ast.AST)]
        elif isinstance(value, ast.AST):
            found.append(value)
    return found


def nodes_of(tree: ast.AST) -> list[ast.AST]:
    """As ``ast.walk``, in its order, without contexts and operators."""
    found = [tree]
    for node in found:  # grows meanwhile
        for name in _FIELDS[node.__class__]:
            value = getattr(node, name, None)
            if value.__class__ is list:
                found += [x for x in value if isinstance(x, ast.AST)]
            elif isinstance(value, ast.AST):
                found.append(value)
    return found


def statements_of(tree: ast.AST) -> list[ast.AST]:
    """The tree and all statements below it, in the order of ``ast.walk``; expressions hold none and are passed over."""
    found = [tree]
    for node in found:
        for name in ("body", "handlers", "orelse", "finalbody", "cases"):
            value = getattr(node, name, None)
            if value.__class__ is list:
                found += [x for x in value if isinstance(x, _HOLDERS)]
    return found


def _bare(tree: ast.AST) -> ast.AST:
    """The tree without docstrings and with decorators in order of their text."""
    for node in statements_of(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Module)):
            body = node.body
            if body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
                node.body = body[1:] or [ast.Pass()]
            if hasattr(node, "decorator_list"):
                node.decorator_list.sort(key=ast.unparse)
    return tree


def canonical(source: str) -> str:
    """A source's text without comments, docstrings and layout; sources that do not parse keep their tokens."""
    try:
        return ast.unparse(_bare(ast.parse(source)))
    except SyntaxError:
        return " ".join(line.split("#")[0].strip() for line in source.splitlines())


def structural(source: str) -> str:
    """As ``canonical``, with names numbered by first use, and literals and decorators by their kind."""
    return _structural(canonical(source))


#: Names that stay, and what stands for a token of a type.
_KEPT = {*keyword.kwlist, *dir(builtins), "self", "cls"}
_STANDS = {t: "S" for t, name in tokenize.tok_name.items() if t == tokenize.STRING or name.startswith("FSTRING")} | {tokenize.NUMBER: "N", tokenize.INDENT: "{", tokenize.DEDENT: "}"}
_BREAKS, _PASSED = (tokenize.NEWLINE, tokenize.NL), (tokenize.ENCODING, tokenize.ENDMARKER, tokenize.COMMENT)


def _structural(plain: str) -> str:
    """``structural`` of a source that is canonical."""
    names: dict[str, str] = {}
    out, line_starts, skip = [], True, False
    try:
        for kind, string, *_ in tokenize.generate_tokens(io.StringIO(plain).readline):
            if kind in _BREAKS:
                line_starts, skip = True, False
                continue
            if line_starts and string == "@":
                out.append("@DECORATOR")
                skip = True
            line_starts = False
            if skip or kind in _PASSED:
                continue
            if kind == tokenize.NAME and string not in _KEPT:
                out.append(names.setdefault(string, f"I{len(names)}"))
            else:
                out.append(_STANDS.get(kind, string))
    except (tokenize.TokenError, IndentationError):
        pass
    return " ".join(out)


def ast_hash(source: str) -> str:
    return sha256(canonical(source))


def structural_hash(source: str) -> str:
    return sha256(structural(source))


#: Sources up to so many characters are remembered with their hashes, and so many of them: copies of a definition are hashed once.
_SHORT, _REMEMBERED = 4096, 4096


def _hashes(source: str) -> tuple[str, str]:
    plain = canonical(source)
    return sha256(plain), sha256(_structural(plain))


_known_hashes = lru_cache(_REMEMBERED)(_hashes)


def hashes(source: str) -> tuple[str, str]:
    """``ast_hash`` and ``structural_hash``, with one parse."""
    return _known_hashes(source) if len(source) <= _SHORT else _hashes(source)


def dedented(text: str, column: int) -> str:
    """A definition's text, moved left by the column that it begins in."""
    lines = text.split("\n")
    return "\n".join([lines[0], *(line[column:] if line[:column].isspace() else line for line in lines[1:])])


def _definition(source: str) -> ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef | None:
    try:
        body = ast.parse(source).body
    except SyntaxError:
        return None
    return next((n for n in body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))), None)


def signature_of(node: ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) -> str:
    """The definition line on one line, without its colon."""
    if isinstance(node, ast.ClassDef):
        bases = ", ".join([*map(ast.unparse, node.bases), *(ast.unparse(k) for k in node.keywords)])
        return f"class {node.name}({bases})" if bases else f"class {node.name}"
    returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    return f"{'async ' if isinstance(node, ast.AsyncFunctionDef) else ''}def {node.name}({ast.unparse(node.args)}){returns}"


def signature(source: str) -> str | None:
    node = _definition(source)
    return signature_of(node) if node else None


def return_type(source: str) -> str | None:
    node = _definition(source)
    return ast.unparse(node.returns) if node is not None and getattr(node, "returns", None) else None


def params_of(node: ast.FunctionDef | ast.AsyncFunctionDef) -> list[dict[str, str | None]]:
    """Parameters with hints, defaults and kinds, without self and cls."""
    a = node.args
    out = []

    def add(arg: ast.arg, default: ast.expr | None, kind: str) -> None:
        out.append({"name": arg.arg, "type_hint": ast.unparse(arg.annotation) if arg.annotation else None, "default": ast.unparse(default) if default else None, "kind": kind})

    plain = [*a.posonlyargs, *a.args]
    for arg, default in zip(plain, [None] * (len(plain) - len(a.defaults)) + list(a.defaults), strict=True):
        if not (arg is plain[0] and arg.arg in ("self", "cls")):
            add(arg, default, "positional_or_keyword")
    if a.vararg:
        add(a.vararg, None, "var_positional")
    for arg, default in zip(a.kwonlyargs, a.kw_defaults, strict=True):
        add(arg, default, "keyword_only")
    if a.kwarg:
        add(a.kwarg, None, "var_keyword")
    return out


def params(source: str) -> list[dict[str, str | None]]:
    node = _definition(source)
    return params_of(node) if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else []


def signature_changed(old: str, new: str) -> bool:
    """Whether parameters or the return type differ."""
    return (params(old), return_type(old)) != (params(new), return_type(new))
