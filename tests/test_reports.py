from datetime import datetime, timedelta

import pytest
from test_store import rows

from mergelens.operators import health, metrics
from mergelens.plans.fixture import ORG, REPO, fixture_prs, scoped
from mergelens.reports.build import AUTHOR_HEAD, REPO_HEAD, collection_report, contributor_report, dashboard, markdown_report, observations, observed_span

NOW = datetime(2001, 8, 2, 12)
MON = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def small(spark):
    """Six people; big ones merge slowly; p0 reviews p1's work and merges their own."""
    out = []
    for i in range(12):
        who = f"p{i % 6}" if i < 8 else "p0"
        out.append({
            "pr_number": i, "author": who, "created_at": MON + timedelta(3 * i), "pr_size": 10 if i % 2 else 500, "reviewers": "p0" if who == "p1" else "",
            "state": "merged" if i % 3 else "open", "time_to_merge_hours": (5.0 if i % 2 else 50.0) if i % 3 else None, "self_merged": who == "p0" and bool(i % 3),
        })
    return rows(spark, *out)


def line(text, start):
    (found,) = [x for x in text.splitlines() if x.startswith(start)]
    return found.split()


def test_dashboard_figures(small):
    text = dashboard(small, "o", "r", now=NOW, colour=False)
    assert "== Activity - o / r ==\n12 pull requests by 6 people in 1 repositories\nopened from 2024-01-01 to 2024-02-03" in text
    assert line(text, "merged  ") == ["merged", "8", "(66.7%)"] and line(text, "mean changed") == ["mean", "changed", "lines", "255"]
    assert line(text, "mean hours") == ["mean", "hours", "to", "merge", "27.5"] and line(text, "opened a day") == ["opened", "a", "day", "0.4"]
    # p0 opened 0, 6, 8, 9, 10, 11; of these 8, 10 and 11 are merged
    assert line(text, "p0  ") == ["p0", "6", "3", "337", "35.0h", "███████░░░░░░░░", "50.0%"]
    assert line(text, "Small") == ["Small", "(<50)", "6", "████████████████████", "50.0%", "5.0h"]
    assert "The busiest fifth of the people opened 50% of the pull requests." in text
    assert "Large (>200) took longest to merge, 50.0 hours; Small (<50) was quickest with 5.0." in text
    assert "Less than 70% were merged in 1 of 1 repositories, first r." in text


def test_dashboard_of_the_tables(spark, sf):
    prs = fixture_prs(spark, sf)
    text = dashboard(prs, ORG, now=NOW, colour=False)
    s = metrics.summary_stats(prs).first()
    assert f"{s['total_prs']} pull requests by {s['unique_authors']} people" in text
    for a in metrics.author_stats(prs).collect():
        assert line(text, f"{a['author']}  ")[1:3] == [str(a["pr_count"]), str(a["merged_count"])]
    assert dashboard(None) == "Nothing has been collected yet"


def test_markdown_figures(small):
    text = markdown_report(small, "o", now=NOW)
    assert text.startswith("# Pull requests - o\n\nWritten 2001-08-02 12:00.")
    assert "| 2024-01-01 | 2024-02-03 | 1 | 6 | 12 | 8 | 66.7 | 255 | 27.5 | 0.4 |" in text
    assert "| " + " | ".join(AUTHOR_HEAD) + " |" in text and "| " + " | ".join(REPO_HEAD) + " |" in text
    assert "| r | 12 | 8 | 6 | 255.0 | 27.5 | 66.7 |" in text and "| Large (>200) | 6 | 50.0 |" in text
    assert "| 2024-01 | 11 |" in text and "| 2024-02 | 1 |" in text
    assert "## Months" not in markdown_report(small.where("pr_number < 4"), "o", now=NOW)


def test_contributor_figures(small):
    text = contributor_report(small, "o", "r", now=NOW, colour=False)
    assert "6 people opened 12 pull requests in 34 days, 66.7% merged" in text and "66.7% merged, 27.5 hours to merge, 255 lines" in text
    p0 = line(text, "p0  ")
    assert p0[1:4] == ["6", "3", "50.0%"] and p0[6:] == ["2", "100.0%", "Below"]
    assert "work is spread: 1 of the busiest opened 50.0%" in text and "moderate" not in text
    people = metrics.contributor_stats_for_repo(small, "o", "r")
    assert health.review_participation(people).first()["reviewers"] == 1 and "few people review: 1 of 6 people" in text
    none = contributor_report(small, "o", None)
    assert none == "A repository is needed to report on its people"


def test_contributors_of_the_tables(spark, sf):
    prs = scoped(spark, sf)
    text = contributor_report(prs, ORG, REPO, now=NOW, colour=False)
    for r in metrics.contributor_stats_for_repo(prs, ORG, REPO).collect():
        assert line(text, f"{r['author']}  ")[1:3] == [str(r["pr_count"]), str(r["merged_count"])]
    assert contributor_report(prs.where("false"), ORG, REPO) == "The repository has no dated pull requests"
    assert observed_span(prs) > 1000


def test_collection_figures(small):
    text = collection_report(small, 14).splitlines()
    assert text[:3] == ["Collected 12 pull requests, 8 merged (66.7%)", "0.6 merged a day, 255 lines each", "27.5 hours to merge"]
    assert text[3].startswith("Busiest: p0 6, ")


def test_nothing_stands_out():
    assert observations([], [], [], []) == []
