"""Command line: build-network, dedup, clean, unmatched, fetch, serve."""

from __future__ import annotations

import argparse

from epistola.functions import rules
from epistola.operators import cleaning, merge, network, search
from epistola.operators.resolve import Resolution
from epistola.session import build_session
from epistola.service import Service
from epistola.sources import bundle, graph


def dedup(nodes, edges, fuzzy: bool = True, tables: dict | None = None):
    """(nodes, edges, alias map, layer statistics) of a resolved graph."""
    r = Resolution(nodes, **(tables or {})).run(fuzzy)
    best = merge.best_ids(r.state, nodes, r.address_repairs, r.domain_repairs)
    return merge.merge_nodes(nodes, best, r.domain_repairs), merge.merge_edges(edges, best), best, r.layer_stats()


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="epistola")
    sub = p.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build-network")
    b.add_argument("documents")
    b.add_argument("--output", required=True)
    b.add_argument("--max-docs", type=int)
    b.add_argument("--min-count", type=int, default=1)
    b.add_argument("--min-weight", type=int, default=1)
    d = sub.add_parser("dedup")
    d.add_argument("input")
    d.add_argument("--output", "-o")
    d.add_argument("--dry-run", action="store_true")
    d.add_argument("--report", action="store_true")
    d.add_argument("--no-fuzzy", action="store_true")
    d.add_argument("--rules", metavar="FILE", help="repairs, role words and first names of the deployment, as JSON")
    c = sub.add_parser("clean")
    c.add_argument("documents")
    c.add_argument("--apply", metavar="FOLDER", help="write a cleaned version into a new folder below this one")
    c.add_argument("--sample", type=int)
    u = sub.add_parser("unmatched")
    u.add_argument("graph")
    u.add_argument("documents")
    f = sub.add_parser("fetch")
    f.add_argument("request")
    f.add_argument("documents")
    f.add_argument("--store", required=True)
    w = sub.add_parser("serve")
    w.add_argument("documents")
    w.add_argument("--store", required=True)
    w.add_argument("--port", type=int, default=8000)
    a = p.parse_args(argv)
    spark = build_session()
    if a.cmd == "build-network":
        nodes, edges = network.build_network(spark.read.parquet(a.documents), a.max_docs, a.min_count, a.min_weight)
        print(graph.write_graph(nodes, edges, a.output))
    elif a.cmd == "dedup":
        nodes, edges = graph.read_graph(spark, a.input)
        merged, medges, best, stats = dedup(nodes, edges, not a.no_fuzzy, rules.load(a.rules) if a.rules else None)
        stats.show(50, False)
        if a.report:
            merge.merge_report(best).show(100, False)
        if not a.dry_run:
            merge.invariants(nodes, merged, medges).show()
            print(graph.write_graph(merged, medges, a.output or a.input))
    elif a.cmd == "clean":
        docs = spark.read.parquet(a.documents).where("text IS NULL OR text <> ''")
        if a.sample:
            docs = docs.orderBy("hash_id").limit(a.sample)
        done = cleaning.clean(docs)
        cleaning.document_counters(done).show()
        cleaning.fix_totals(done).show(200, False)
        if a.apply:
            print(graph.write_version(done.withColumn("text", done.cleaned).select(*docs.columns), a.apply))
    elif a.cmd == "unmatched":
        nodes, _ = graph.read_graph(spark, a.graph)
        for r in search.unmatched(nodes, spark.read.parquet(a.documents)).toJSON().toLocalIterator():
            print(r)
    elif a.cmd == "serve":
        docs = spark.read.parquet(a.documents)
        Service(spark, {"documents": (docs, "hash_id")}, docs, bundle.FolderStore(a.store)).serve(port=a.port).serve_forever()
    else:
        print(bundle.fetch_bundle(spark.read.parquet(a.documents), bundle.Request.read(a.request), bundle.FolderStore(a.store)).json())


if __name__ == "__main__":
    main()
