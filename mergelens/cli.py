"""Command line: collect pull requests, or report on those collected."""

from __future__ import annotations

import argparse
from datetime import datetime

from .checkpoints import checkpoint
from .operators.normalize import event_lists, normalize
from .operators.scope import dropped_repos, with_min_prs
from .reports.build import collection_report, contributor_report, dashboard, markdown_report
from .session import get_session
from .sources import hosting, store
from .sources.tool import run_tool

OUTPUT = "output"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mergelens", description=__doc__)
    p.add_argument("--days", type=int, default=14, help="days back to analyze")
    p.add_argument("--min-prs", type=int, default=3, help="pull requests a repository needs to be reported")
    p.add_argument("--full-scan", action="store_true", help="all repositories, not only recently active ones")
    p.add_argument("--report", action="store_true", help="report on collected data")
    p.add_argument("--terminal", action="store_true", help="terminal report in place of markdown")
    p.add_argument("--org", help="organization (default: MERGELENS_ORG)")
    p.add_argument("--repo", help="limit to one repository")
    p.add_argument("--top-n", type=int, default=5, help="contributors shown week by week")
    p.add_argument("--output", default=OUTPUT, help="folder of the store, snapshots and exports")
    p.add_argument("--as-of", type=datetime.fromisoformat, help="the moment that counts as now")
    p.add_argument("--upsert", action="store_true", help="keep a month's pull requests that were not fetched again")
    return p


def report(spark, args) -> str:
    org = hosting.resolve_org(args.org)
    # stored under the sanitized name
    prs = store.load_prs(spark, f"{args.output}/data", args.output, org=store.sanitize_org_name(org), repo=args.repo, days_back=args.days, as_of=args.as_of)
    if args.terminal and args.repo:
        return contributor_report(prs, store.sanitize_org_name(org), args.repo, args.top_n)
    return dashboard(prs, org, args.repo, args.top_n) if args.terminal else markdown_report(prs, org, args.repo)


def gather(spark, args, run=None) -> str:
    org = hosting.resolve_org(args.org)
    run = run or run_tool
    repos = hosting.org_repos(org, run) if args.full_scan else hosting.recent_repos(spark, org, args.days, args.as_of, run)
    # the tool is asked under the organization's own name, and once; only what is stored has the sanitized one
    raw = checkpoint(hosting.collect_raw(spark, org, repos, args.days, args.as_of, run))
    prs = normalize(raw, store.sanitize_org_name(org))
    if prs.isEmpty():
        return f"Nothing collected from {org}"
    kept = with_min_prs(prs, args.min_prs)
    if kept.isEmpty():
        return f"None of the repositories has {args.min_prs} or more pull requests"
    dropped = dropped_repos(prs, args.min_prs).first()["dropped_repos"]
    # the store keeps every repository, the export only the reported ones
    store.write_both(prs, event_lists(raw, store.sanitize_org_name(org)), args.output, keep_others=args.upsert)
    stamp = (args.as_of or datetime.now()).strftime("%Y%m%d_%H%M%S")
    export = f"{args.output}/pr_data_{store.sanitize_org_name(org)}_{stamp}.csv"
    store.write_csv(kept, export, single=True)
    note = f"Left out of the export: {dropped} repositories with fewer than {args.min_prs} pull requests\n" if dropped else ""
    return f"{note}{collection_report(kept, args.days)}\nStore: {args.output}/data and {args.output}/events\nExport: {export}"


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = get_session()
    print(report(spark, args) if args.report else gather(spark, args))


if __name__ == "__main__":
    main()
