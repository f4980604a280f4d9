"""Command line: generate, validate, oracle, embed, publish, probe, loadcheck. Exit codes: 0, 1 refused, 2 no input."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import functions as F

from . import storage
from .operators import bundle, embed, evaluate, report, validate
from .schema import Limits
from .session import build_session
from .sources.generate import generate


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="larkspur")
    sub = top.add_subparsers(dest="stage", required=True)

    def stage(name: str, *options: tuple) -> None:
        p = sub.add_parser(name)
        for flag, settings in options:
            p.add_argument(flag, **settings)

    whole, flag = {"type": int}, {"action": "store_true"}
    need = {"required": True}
    stage("generate", ("--count", whole | {"default": 50_000}), ("--seed", whole | {"default": 42}), ("--out", need))
    stage("validate", ("--input", need), ("--out-dir", need), ("--fail-under", {"type": float}), ("--max-bid", {"type": float}), ("--min-headline-len", whole), ("--limit", whole), ("--quiet", flag))
    stage("oracle", ("--oracle", need), ("--report", need))
    stage("embed", ("--input", need), ("--out-dir", need), ("--batch-size", whole | {"default": 256}), ("--model", {"default": "hashing"}), ("--device", {}), ("--revision", {}), ("--allow-truncation", flag), ("--limit", whole), ("--quiet", flag))
    stage("publish", ("--clean", need), ("--embedded", need), ("--out-root", need), ("--quiet", flag))
    stage("probe", ("--published", need), ("--k", whole | {"default": 5}), ("--query", {"action": "append"}), ("--dump-ground-truth", {}))
    stage("loadcheck", ("--root", need), ("--ground-truth", {}))
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = build_session()
    told = ""
    try:
        if a.stage == "generate":
            told = json.dumps(generate(spark, a.count, a.seed, a.out))
        elif a.stage == "validate":
            bounds = {k: v for k, v in (("bid_max", a.max_bid), ("headline_min", a.min_headline_len)) if v is not None}
            told = report.summary(validate.validate(spark, a.input, a.out_dir, limits=Limits(**bounds), limit=a.limit, fail_under=a.fail_under))
        elif a.stage == "oracle":
            for path in (a.oracle, a.report):
                if not storage.is_file(spark, path):
                    raise FileNotFoundError(path)
            diff = evaluate.oracle_diff(spark, json.loads(storage.read_text(spark, a.oracle)), json.loads(storage.read_text(spark, a.report))).orderBy("code").collect()
            told = "\n".join(f"{r['code']:<10} {r['expected']:>9,} {r['actual']:>9,} {'' if r['agree'] else 'differs'}" for r in diff)
            if not all(r["agree"] for r in diff):
                raise validate.GateError(told)
        elif a.stage == "embed":
            told = embed.summary(embed.embed(spark, a.input, a.out_dir, embed.load_embedder(a.model, a.device, a.revision), batch_size=a.batch_size, allow_truncation=a.allow_truncation, limit=a.limit))
        elif a.stage == "publish":
            told = bundle.summary(bundle.publish(spark, a.clean, a.embedded, a.out_root))
        elif a.stage == "probe":
            loaded = bundle.load(spark, a.published)
            asked = [(q, None) for q in a.query] if a.query else evaluate.PROBES
            model = loaded.manifest["model"]
            settings = {"dim": loaded.dim, "max_tokens": model["max_tokens"]} if model["name"] == "hashing" else {}
            embedder = embed.load_embedder(model["name"], revision=model["revision"], **settings)
            hits, rate = evaluate.probe(loaded, embedder, asked, a.k)
            if a.dump_ground_truth:
                evaluate.write_ground_truth(loaded, embedder, hits, asked, a.k, a.dump_ground_truth)
            told = "\n".join(f"{r['query_id']} {r['rank']:>2} {r['score']:.4f} {r['ad_id']} {r['category']}" for r in hits.orderBy("query_id", "rank").collect()) + f"\nprecision at {a.k}: {rate}"
        else:
            began = time.monotonic()
            loaded = bundle.load(spark, a.root)
            told = f"{bundle.report(loaded)}\nsizes, checksums, norms, rows and ids agree; loaded in {time.monotonic() - began:.1f} s"
            nearest = loaded.top_k(loaded.vector(0), 1).select(F.round("score", 4)).first()[0]
            told += f"\nfirst vector finds itself with score {nearest}"
            if a.ground_truth:
                faults = evaluate.replay(loaded, a.ground_truth).orderBy("query_id", "at").limit(20).collect()
                if faults:
                    raise bundle.BundleError("\n".join(f"query {r['query_id']}, position {r['at']}: {r['fault']}" for r in faults))
                told += "\nthe ground truth agrees"
    except FileNotFoundError as error:
        print(f"no input: {error}", file=sys.stderr)
        return 2
    except (validate.GateError, embed.TruncationError, bundle.BundleError, evaluate.StaleError) as error:
        print(error, file=sys.stderr)
        return 2 if isinstance(error.__cause__, FileNotFoundError) else 1
    if not getattr(a, "quiet", False):
        print(told)
    return 0


if __name__ == "__main__":
    sys.exit(main())
