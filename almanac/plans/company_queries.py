"""Queries on the identity of companies, and the SQL that checks them."""

from __future__ import annotations

from almanac.operators import companies as co
from almanac.plans.rollup_queries import S
from almanac.session import table

RULES = co.CompanyRules(
    {"OrvantaCloud": "Orvanta Cloud", "Orvanta": "Orvanta Cloud", "Orvanta Cloud, Inc.": "Orvanta Cloud", "The Orvanta Cloud Company": "Orvanta Cloud", "Orvanta-Cloud": "Orvanta Cloud", "The Mevorefede Pharmaceuticals": "Mevorefede Pharmaceuticals", "Mevorefede Insurance": "Mevorefede Group", "Zostalufasa Motors": "Zostalufasa & Sons"},
    ("Orvanta Cloud",), ("orvanta",),
)


def _s(spark, d):
    return table(spark, d, "classified_sessions")


QUERIES = {
    "company_alias": lambda spark, d: co.identities(_s(spark, d), RULES),
    "company_ranking": lambda spark, d: co.ranking(_s(spark, d), RULES),
    "company_distinct": lambda spark, d: co.distinct_count(_s(spark, d), RULES),
    "explorer_company_alias": lambda spark, d: co.speaking(_s(spark, d), RULES, "mevorefede insurance"),
}

_KEY = "trim(regexp_replace(replace(lower(trim({0})), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
_MAP = "MAP {" + ", ".join(f"'{co.plain_text(k)}': '{v}'" for k, v in RULES.aliases.items()) + "}"
_NAMED = f"WITH {S}, c AS (SELECT DISTINCT id, title, trim(coalesce(x.company, '')) AS company FROM (SELECT id, title, unnest(speakers) AS x FROM s)), n AS (SELECT *, coalesce({_MAP}[{_KEY.format('company')}], company) AS canonical FROM c), k AS (SELECT *, {_KEY.format('canonical')} AS key, canonical <> '' AND (canonical = 'Orvanta Cloud' OR list_contains(string_split({_KEY.format('canonical')}, ' '), 'orvanta')) AS own FROM n) "

ORACLES = {
    "company_alias": _NAMED + "SELECT company, canonical, key, own, count(DISTINCT id) AS sessions FROM k WHERE company <> '' GROUP BY ALL",
    "company_ranking": _NAMED + "SELECT canonical AS company, count(DISTINCT id) AS sessions FROM k WHERE canonical <> '' AND NOT own GROUP BY canonical HAVING count(DISTINCT id) >= 2 ORDER BY sessions DESC, company LIMIT 120",
    "company_distinct": _NAMED + "SELECT count(DISTINCT canonical) AS companies, count(DISTINCT canonical) FILTER (NOT own) AS other_companies FROM k WHERE canonical <> ''",
    "explorer_company_alias": _NAMED + "SELECT DISTINCT id, title FROM k WHERE contains(lower(company), 'mevorefede insurance') OR canonical = 'Mevorefede Group' OR contains(key, 'mevorefede group')",
}
