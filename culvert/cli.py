"""python -m culvert.cli FILE.ssn [--size] [--review]: analyses network files and prints reports."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culvert.operators.design import review_analysis, size_network
from culvert.operators.network import Analysis, analyze
from culvert.sinks import report
from culvert.sources.ssn import Networks, parse_ssn, read_ssn


def _analysis(networks: Networks) -> tuple[DataFrame, DataFrame, Analysis]:
    """Nodes and pipes of the files without errors, and their analysis."""
    good = lambda df: df.join(networks.errors.select("network_id").distinct(), "network_id", "left_anti")
    nodes, pipes = good(networks.nodes), good(networks.pipes)
    return nodes, pipes, analyze(nodes, pipes, good(networks.idf), scenarios=networks.scenarios)


def reports(networks: Networks, size: bool = False, check: bool = False) -> list[DataFrame]:
    """Report texts (network_id, rp_years, text) of parsed networks; files with errors have none."""
    nodes, pipes, analysis = _analysis(networks)
    made = [report.text_reports(analysis.pipes, analysis.nodes)]
    if size:
        made.append(report.sizing_tables(size_network(pipes, analysis.pipes)))
    if check:
        made.append(report.review_texts(review_analysis(nodes, pipes, analysis)))
    return made


def analyze_ssn(found: DataFrame) -> DataFrame:
    """(network_id, rp_years, text): the plain report of each `.ssn` text (network_id, file, text), or
    its first error."""
    networks = parse_ssn(found)
    first = networks.errors.groupBy("network_id").agg(F.min_by("error", "line_no").alias("error"))
    analysis = _analysis(networks)[2]
    failed = first.unionByName(analysis.errors.groupBy("network_id").agg(F.min("error").alias("error")))
    failed = failed.select("network_id", F.lit(None).cast("int").alias("rp_years"), F.concat(F.lit("error: "), "error").alias("text"))
    return report.text_reports(analysis.pipes, analysis.nodes).unionByName(failed)


def main(argv: list[str]) -> int:
    paths = [a for a in argv if not a.startswith("--")]
    flags = {a for a in argv if a.startswith("--")}
    if len(paths) != 1 or flags - {"--size", "--review"}:
        print(__doc__, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("culvert").getOrCreate()
    try:
        networks = read_ssn(spark, paths[0])
        failed = False
        for row in networks.errors.orderBy("network_id", "line_no").toLocalIterator():
            print(f"error: {row.error}", file=sys.stderr)
            failed = True
        if failed:
            return 1
        for texts in reports(networks, "--size" in flags, "--review" in flags):
            for row in texts.orderBy("network_id").toLocalIterator():
                print(row.text)
    except Exception as error:  # noqa: BLE001
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
