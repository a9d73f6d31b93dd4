"""python -m quillmesh.cli init|index|merge|status|explain|path|query|visualize|serve"""

import argparse
import json
import os
import sys
from functools import partial


def _path(api, nodes, links, args, have) -> dict:
    cost = {"default": have.path_confidence_default, "floor": have.path_confidence_floor, "inferred": have.path_provenance_inferred_factor}
    return api.path(nodes, links, args.start, args.end, have.path_max_hops, have.path_match_threshold, **cost)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillmesh")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, arguments in {
        "index": ["root"], "status": [], "explain": ["concept"], "path": ["start", "end"], "query": ["question"], "visualize": ["output"], "merge": ["inputs"], "init": ["file"], "serve": ["port"],
    }.items():
        p = sub.add_parser(name)
        for a in arguments:
            p.add_argument(a, nargs="+" if a == "inputs" else None)
        p.add_argument("--graph")
        p.add_argument("--config")
        for flag in ("--code-only", "--compress", "--versioned", "--force", "--allow-large-repo", "--enrich", "--no-answer"):
            p.add_argument(flag, action="store_true", default=None)
    args = parser.parse_args(argv)
    from . import config

    try:
        if args.command == "init":
            print(config.write_template(args.file, bool(args.force)))
            return 0
        policy = "allow" if args.allow_large_repo else None
        have = config.load(args.config, output=args.graph, code_only=args.code_only, compress=args.compress, versioned=args.versioned, large_repo_policy=policy)
    except config.ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from . import answers, api, models, serve
    from .operators.edges import stats
    from .operators.enrich import reply_schema
    from .operators.merge import DOT_HEAD, DOT_TAIL, LargeRepoError, dot_lines
    from .sources import graph_json

    if args.command not in ("index", "merge", "serve") and not os.path.exists(have.output):
        print(f"no graph at {have.output}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("quillmesh").getOrCreate()
    try:
        given = models.functions(have)
        if args.command == "index":
            chat, notes = None, []
            if args.enrich:
                fine, why = models.ready(have.llm_model, have.llm_base_url)
                chat = partial(given["chat"], schema=reply_schema()) if fine and have.llm_model else None
                if chat is None:
                    print(why or "llm_model is not set", file=sys.stderr)
            nodes, links = api.index(
                spark, args.root, config.ignores(have), max_file_size=have.max_file_size, limits=config.limits(have), code_only=have.code_only,
                scan_bytes=have.max_reference_scan_bytes, languages=have.languages, allow_large=have.large_repo_policy == "allow",
                chat=chat, confidence=have.llm_confidence_threshold, notes=notes,
            )
            print(*notes, sep="\n", end="\n" if notes else "", file=sys.stderr)
            target = graph_json.next_snapshot(os.path.dirname(os.path.abspath(have.output)), have.compress) if have.versioned else have.output
            print(graph_json.write_graph(target, nodes, links, {"project_root": os.path.abspath(args.root)}, have.compress))
        elif args.command == "merge":
            api.merge(spark, args.inputs, have.output)
        elif args.command == "serve":
            serve.server(spark, int(args.port), **given).serve_forever()
        else:
            nodes, links, _ = graph_json.read_graph(spark, have.output)
            if args.command == "status":
                stats(nodes, links).show(40, False)
            elif args.command == "explain":
                print([r.id for r in api.explain(nodes, links, args.concept, have.explain_hops, have.explain_node_cap, threshold=have.explain_match_threshold, top_n=have.explain_top_n)[2]])
            elif args.command == "path":
                print(json.dumps(_path(api, nodes, links, args, have), indent=2))
            elif args.command == "query":
                print(json.dumps(answers.ask(spark, args.question, have.output, None, have.query_k, have.query_hops, have.query_match_threshold, have.query_node_cap, model=have.llm_model, no_answer=bool(args.no_answer), **given), indent=2))
            else:
                lines = [r.line for r in dot_lines(nodes, links).orderBy("section", "ord", "line").toLocalIterator()]
                graph_json.write_atomic(args.output, "\n".join([*DOT_HEAD, *lines, *DOT_TAIL]) + "\n")
    except LargeRepoError as e:
        print(e, file=sys.stderr)
        return 2
    except Exception as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
