"""Command line: ``python -m tessera index PATH``, ``ask TEXT`` and ``drift PATH [--claims FILE] [--ci]``.

``--model package.module:function`` names what answers prompts: a function from a DataFrame (answer_id, system, prompt) to
(answer_id, text). Without it, ``ask`` points to the best excerpt, and ``drift`` needs a file of claims.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import functions as F

from tessera.config import resolve
from tessera.operators import drift, prompts
from tessera.plans.pipeline import Engine
from tessera.session import get_spark


def _model(name: str | None):  # noqa: ANN202
    if not name:
        return lambda asked: asked.select("answer_id", prompts.first_excerpt(F.col("prompt")).alias("text"))
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--data", default="tessera-data")
    p.add_argument("--repo", default="default")
    p.add_argument("--model")
    sub = p.add_subparsers(dest="mode", required=True)
    sub.add_parser("index").add_argument("path")
    sub.add_parser("ask").add_argument("text")
    check = sub.add_parser("drift")
    check.add_argument("path")
    check.add_argument("--claims", help="JSON lines of claim, doc_file and doc_line, instead of a model that reads them")
    check.add_argument("--ci", action="store_true", help="exit with 1 if a claim is contradicted")
    said = p.parse_args(args)
    spark = get_spark("tessera")
    engine = Engine(spark, said.data, resolve(spark), progress=lambda stage, message: print(f"{stage}: {message}", file=sys.stderr))
    if said.mode == "index":
        engine.index(said.path, said.repo).show(truncate=False)
    elif said.mode == "ask":
        query = prompts.asked(spark.createDataFrame([(1, said.text)], "query_id long, text string"))
        found = engine.answer(query, _model(said.model), repo_id=said.repo).collect()
        if not found:
            p.error("the question is blank")
        for r in found:
            print(f"{r.text}\n\ngrounding: {r.verdict} ({r.score:.2f})" + ("" if r.ok else "\nnot all citations exist"))
    else:
        if said.claims:
            claims = spark.read.schema("claim string, doc_file string, doc_line long").json(said.claims).withColumn("claim_id", F.monotonically_increasing_id())
            found = engine.drift(claims, repo_id=said.repo)
        elif said.model:
            found = engine.check_documents(said.path, said.repo, _model(said.model))
        else:
            p.error("drift needs --claims or --model")
        drift.markdown(found, said.repo, sys.stdout)
        return int(said.ci and found.where("status = 'contradicted'").limit(1).count() > 0)
    return 0


if __name__ == "__main__":
    sys.exit(main())
