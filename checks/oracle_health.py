"""The health query in SQL, put together from the SQL of its parts."""

from __future__ import annotations

from collections.abc import Mapping

#: Parts that are one row of metrics: query -> section.
ROWS = {
    "corpus_counts": "corpus", "reconcile_runs": "reconciliation", "query_totals": "queries", "token_summary": "tokens",
    "answer_totals": "answers", "unreadable_runs": "unreadable", "answer_sources": "answer_sources", "evidence_links": "evidence_links",
}
#: Parts that are counts by a key: query -> section, metric, key, value.
KEYED = {
    "terms_by_field": ("input", "terms_by_field", "field", "n"), "placeholder_counts": ("templating", "placeholder", "field", "n"),
    "tier_mix": ("tokens", "service_tier", "tier", "n"),
}
#: Parts that already are metric rows.
METRICS = ("call_breakdowns", "answer_breakdowns", "citation_breakdowns")


def _one_row(sql: str, section: str) -> str:
    return f"""select '{section}' section, metric, null::varchar "key", "value"
from (select columns(*)::double from ({sql})) unpivot include nulls ("value" for metric in (columns(*)))"""


def health_sql(parts: Mapping[str, str]) -> str:
    out = [_one_row(parts[name], section) for name, section in ROWS.items()]
    out.append(_one_row(f"select *, n_templated > 0 has_run from ({parts['masking_totals']})", "templating"))
    out.append(_one_row(f"select * exclude (n_billed) from ({parts['head_coverage']})", "templating"))
    out += [
        f"select '{section}', '{metric}', {key}::varchar, {value}::double from ({parts[name]})"
        for name, (section, metric, key, value) in KEYED.items()
    ]
    out += [
        f"select 'agreement', '{m}', other, {m}::double from ({parts['agreement_tallies']})"
        for m in ("n_agree", "n_differ", "n_not_comparable", "differ_rate")
    ]
    out += [f'select section, metric, "key"::varchar, "value" from ({parts[name]})' for name in METRICS]
    out.append(f"select 'anomalies', 'code', code, count(*)::double from ({parts['weblog_anomalies']}) group by code")
    out.append(_one_row(f"select count(*) n_questions, count(*) <> 8 is_unexpected from ({parts['output_questions']})", "questions"))
    out.append(_one_row(f"select count(*) n_votes, count(*) filter (differs) n_differ from ({parts['output_votes']})", "votes"))
    return " union all ".join(out)
