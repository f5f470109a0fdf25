"""Command line: parse documents, parse bodies, list profiles."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.functions import norms as N
from normloom.operators import matching as M
from normloom.operators import outline as O
from normloom.operators import render as R
from normloom.operators import runs as U
from normloom.operators import segment as S
from normloom.operators import validate as V
from normloom.sources import profiles as P
from normloom.sources import readers


def parse_documents(blocks: DataFrame, profile: P.Profile, norm_id: str | None = None, use_links: bool = True, rules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents as XML (doc_id, xml) and their problems (doc_id, code, message) from blocks by one profile.

    rules: patterns and messages of texts that no provision may have.
    """
    # parts and nodes are read by several of the steps below; kept, they also keep the plans short
    parts = S.parts(U.trim_ends(readers.lines(blocks)), profile).persist()
    docs = S.documents(parts, profile).persist()
    nodes = M.find_links(O.summaries(O.outline(S.body(parts)).persist()), use=use_links)
    if use_links:
        keys = ["doc_id", "run_parent"]
        cited, fragments = M.amendment_links(nodes)
        best = M.best_matches(M.matches(cited, fragments, keys), keys)
        nodes = M.with_overrides(nodes, M.rewritten(best, M.best_base(best, keys), keys)).persist()
    urn = N.urn(F.lit(profile.locality), F.lit(profile.authority), F.lit(profile.type), F.lit(norm_id))
    whole = docs.join(R.xml_body(nodes), "doc_id", "left")
    xml = whole.select("doc_id", R.document_xml(urn, R.initial_part_xml(F.col("heading"), F.col("summary"), F.col("preamble")), F.col("body")).alias("xml"))
    columns = ["doc_id", "code", "message", "position"]
    found = V.validate(nodes).select(*columns).unionByName(V.document_problems(docs).select(*columns)).unionByName(V.unclosed_amendments(O.unclosed(S.body(parts))).select(*columns))
    if rules is not None:
        found = found.unionByName(V.forbidden_text(nodes, rules).select(*columns))
    failed = blocks.where("problem is not null").select("doc_id", F.col("problem").alias("code"), F.lit(V.CODES[15][1]).alias("message"), F.lit(None).cast("string").alias("position"))
    return xml, found.unionByName(failed).distinct()


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="normloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("parse", "parse-body"):
        p = commands.add_parser(name)
        p.add_argument("path", help="a file or folder; - for standard input")
        p.add_argument("--mime", help="type of standard input")
        p.add_argument("--locality", default="br")
        p.add_argument("--authority", default="federal")
        p.add_argument("--type", default="lei")
        p.add_argument("--id", help="date-or-year;number[-complement][@version]")
        p.add_argument("--override", help="JSON of profile fields")
        p.add_argument("--no-links", action="store_true")
        p.add_argument("--forbidden", help="files of rules /pattern/,message that no provision's text may match")
        p.add_argument("--html", action="store_true", help="bodies as HTML in place of XML")
        p.add_argument("--output", help="folder for Parquet; default: print")
        p.add_argument("--info", action="store_true", help="print the parameters and stop")
    commands.add_parser("profiles")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = _arguments(argv)
    spark = SparkSession.builder.appName("normloom").getOrCreate()
    if a.command == "profiles":
        P.dump(P.profiles(spark)).show(2000, truncate=False)
        return 0
    profile = P.find(a.locality, a.authority, a.type)
    if a.override:
        row = spark.range(1).select(P.overrides_from_json(F.lit(a.override)).alias("o")).first().o
        profile = P.override(profile, **row.asDict())
    if a.info:
        print(a, profile, sep="\n")
        return 0
    docs = readers.bytes_of(spark, sys.stdin.buffer.read(), a.mime or "text/plain") if a.path == "-" else readers.files(spark, a.path)
    blocks = readers.documents(docs)
    if a.command == "parse":
        xml, problems = parse_documents(blocks, profile, a.id, not a.no_links, readers.regex_rules(spark, a.forbidden) if a.forbidden else None)
    else:
        nodes = O.outline(readers.lines(blocks)).persist()
        xml, problems = (R.html_body if a.html else R.xml_body)(nodes).withColumnRenamed("body", "xml"), V.validate(nodes).select("doc_id", "code", "message", "position")
    if a.output:
        xml.write.mode("overwrite").parquet(f"{a.output}/xml")
        problems.write.mode("overwrite").parquet(f"{a.output}/problems")
        return 0
    for row in xml.toLocalIterator():
        print(row.xml)
    for row in problems.toLocalIterator():
        print(*row, sep="\t", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
