"""op4_url_filter over the given pages: the list decides about real rows."""

import hashlib

import pytest

from barflow.llm.queries import RULES, op4_url_filter

from .test_urls_topk import canonical


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_listed_pages_are_blocked(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("page_id", "url").collect()}
    got = op4_url_filter(spark, f"/root/testdata/{sf}").collect()
    assert sorted(r.page_id for r in got) == sorted(urls)
    by_list = 0
    for r in got:
        host, path, known = canonical(urls[r.page_id])
        fit = [(len(rule), rule, v) for v, rule in RULES for h, _, p in [rule.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        listed = known != "" and hashlib.md5(known.encode()).hexdigest()[0] in "01"
        by_list += not fit and listed
        assert (r.rule, r.verdict) == (max(fit)[1:] if fit else (None, "block" if listed else "allow"))
    # a rule decides about a few rows in ten, the list about an eighth of the rest
    assert by_list > len(urls) / 20
