"""Sources from statement tables: functions and modules written anew from their parts.

A function's statements form a tree of bounded depth (statements, control flows, branches); each function is put
together by itself, so a module with very many functions is never one task's work until its text is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import ship


def function_source(signature: str, docstring: str | None, parts: list[dict]) -> str:
    """Text of a function from rows (id, label, kind, text, condition, seq, parent) of its statements; ``parent`` of the top ones is null."""
    children: dict[str | None, list[dict]] = {}
    for p in sorted(parts, key=lambda p: p["seq"] or 0):
        children.setdefault(p["parent"], []).append(p)

    def block(parent: str | None, depth: int) -> list[str]:
        pad, out = "    " * depth, []
        for p in children.get(parent, []):
            if p["label"] == "Statement":
                out += [pad + line if i == 0 else line for i, line in enumerate((p["text"] or "pass").split("\n"))]
                continue
            for b in children.get(p["id"], []):
                head = {"if": f"if {b['condition']}:", "elif": f"elif {b['condition']}:", "else": "else:", "for": f"for {b['condition']}:", "while": f"while {b['condition']}:", "try": "try:", "finally": "finally:", "with": f"with {b['condition']}:", "except": f"except {b['condition']}:" if b["condition"] else "except:"}[b["kind"]]
                out.append(pad + head)
                out += block(b["id"], depth + 1) or [pad + "    pass"]
        return out

    doc = [f'    """{docstring}"""'] if docstring else []
    return "\n".join([f"{signature}:", *(doc + block(None, 1) or ["    pass"])]) + "\n"


def functions(nodes: DataFrame, statements: DataFrame) -> DataFrame:
    """(name, source) of every function whose statements are known, by (id, signature, docstring) and its statements.

    A statement belongs to the function whose name its id begins with.
    """
    ship(nodes.sparkSession)
    owner = F.regexp_replace("id", r"\.(?:cf|stmt|block)_.*$", "")
    own = statements.withColumn("name_of", owner)
    rows = own.select("name_of", F.struct("id", "label", "kind", F.col("source_text").alias("text"), F.col("condition_text").alias("condition"), "seq", F.when(F.col("parent") != F.col("name_of"), F.col("parent")).alias("parent")).alias("part"))
    parts = rows.groupBy("name_of").agg(F.collect_list("part").alias("parts"))
    found = nodes.where("kind IN ('function', 'method')").select("name", "signature", "docstring").join(parts, F.col("name") == F.col("name_of"), "left").select("name", "signature", "docstring", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, signatures, docs, many = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([function_source(s, d, p or []) for s, d, p in zip(signatures, docs, many, strict=True)], pa.string())], names=["name", "source"])

    return found.mapInArrow(run, "name string, source string")
