"""The queries' results stated in SQL: common table expressions, of which each statement takes those it names."""

from __future__ import annotations

import re

from ..operators.analysis import ANNUAL, FLOWS, STOCKS
from ..operators.fundamentals import CLEAN_RATIOS, EPS_TAGS
from ..operators.snapshot import INSTANTS, TTM_METRICS
from ..sources import adapters
from ..sources.concepts import CONCEPTS_SQL, METRICS_SQL, SIC_SQL

_T = {t: t for t in ("lineitem", "supplier", "documents", "events", "benchmark")}


def _held(a: str, until: str) -> str:
    return f"{a} <= v.as_of AND ({until} IS NULL OR v.as_of < {until})"


def _fundamentals(p: str, k: str, latest: str, dates: str, current: bool) -> dict[str, str]:
    """CTEs named with prefix ``p`` for a view keyed by ``k``."""
    eq = lambda a, b: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in k.split(", "))
    out = {
        f"{p}latest": latest, f"{p}dates": dates,
        f"{p}resolved": f"SELECT {k}, period_start, period_end, metric, l.unit, val, l.concept AS source_concept FROM {p}latest AS l JOIN concept_map AS c ON l.concept = c.concept AND l.unit = c.unit QUALIFY row_number() OVER (PARTITION BY {k}, period_start, period_end, metric, l.unit ORDER BY priority) = 1",
        f"{p}typed": f"""SELECT r.*, d.filed, d.first_filed, d.first_accn, CASE WHEN r.period_start IS NULL THEN 'INSTANT' WHEN r.period_end - r.period_start BETWEEN 80 AND 100 THEN 'Q' WHEN r.period_end - r.period_start BETWEEN 170 AND 190 THEN 'H' WHEN r.period_end - r.period_start BETWEEN 260 AND 290 THEN 'T9' WHEN r.period_end - r.period_start BETWEEN 340 AND 400 THEN 'FY' END AS period_type, 0 AS derived
 FROM {p}resolved AS r JOIN {p}dates AS d ON {eq('r', 'd')} AND r.period_start IS NOT DISTINCT FROM d.period_start AND r.period_end = d.period_end""",
        f"{p}ytd": f"SELECT {k}, period_start, period_end, metric, unit, val - prev AS val, source_concept, filed, first_filed, first_accn, 'Q' AS period_type, 1 AS derived FROM (SELECT *, lag(val) OVER w AS prev, stage - lag(stage) OVER w AS step FROM (SELECT *, CASE period_type WHEN 'Q' THEN 1 WHEN 'H' THEN 2 WHEN 'T9' THEN 3 ELSE 4 END AS stage FROM {p}typed WHERE unit = 'USD' AND period_type IN ('Q', 'H', 'T9', 'FY')) WINDOW w AS (PARTITION BY {k}, metric, period_start ORDER BY stage)) WHERE step = 1",
        f"{p}known": f"SELECT * FROM (SELECT {k}, period_start, period_end, metric, unit, val, source_concept, filed, first_filed, first_accn, period_type, derived FROM {p}typed WHERE period_type IN ('Q', 'FY', 'INSTANT') UNION ALL SELECT * FROM {p}ytd) QUALIFY row_number() OVER (PARTITION BY {k}, metric, period_end, period_type ORDER BY derived, first_filed DESC, first_accn DESC, period_start DESC NULLS LAST) = 1",
    }

    def q4(src: str, wanted: str) -> str:
        return f"SELECT {', '.join('f.' + c for c in k.split(', '))}, f.period_start, f.period_end, f.metric, f.unit, f.val - sum(q.val) AS val, f.source_concept, f.filed, f.first_filed, f.first_accn, 'Q' AS period_type, 1 AS derived FROM {src} AS f JOIN {src} AS q ON {eq('f', 'q')} AND f.metric = q.metric AND q.period_type = 'Q' AND q.period_end BETWEEN f.period_start AND f.period_end WHERE f.period_type = 'FY' AND {wanted} GROUP BY ALL HAVING count(q.val) = 3 AND max(q.period_end) < f.period_end".replace("GROUP BY ALL", f"GROUP BY {', '.join('f.' + c for c in k.split(', '))}, f.period_start, f.period_end, f.metric, f.unit, f.val, f.source_concept, f.filed, f.first_filed, f.first_accn")

    out[f"{p}with_q4"] = f"SELECT * FROM {p}known UNION ALL {q4(p + 'known', chr(102) + '.unit = ' + chr(39) + 'USD' + chr(39))}"
    cols = f"{k}, metric, period_end, period_type, val, source_concept, derived, filed"
    if current:
        out[f"{p}adjusted"] = f"SELECT {k}, period_start, period_end, metric, unit, CASE WHEN metric IN ('eps_basic', 'eps_diluted') THEN val / factor WHEN metric IN ('shares_diluted', 'shares_outstanding') THEN val * factor ELSE val END AS val, source_concept, filed, first_filed, first_accn, period_type, derived FROM (SELECT f.*, coalesce((SELECT product(s.factor) FROM splits AS s WHERE s.cik = f.cik AND s.effective_filed > f.filed), 1.0) AS factor FROM {p}with_q4 AS f)"
        eps = "f.metric IN ('eps_basic', 'eps_diluted')"
        out[f"{p}f"] = f"SELECT {cols} FROM {p}adjusted UNION ALL SELECT {cols} FROM ({q4(p + 'adjusted', eps)})"
    else:
        out[f"{p}f"] = f"SELECT {cols} FROM {p}with_q4"
    return out


def _snapshot(p: str, k: str, base: str, price: str) -> dict[str, str]:
    on = " AND ".join(f"b.{c} = %s.{c}" for c in k.split(", "))
    pick = lambda names, col: ", ".join(f"max(CASE WHEN metric = '{m}' THEN {col} END) AS {m}" for m in names)
    return {
        f"{p}ttm": f"SELECT {k}, metric, CASE WHEN count(CASE WHEN period_type = 'Q' THEN val END) = 4 AND max(CASE WHEN period_type = 'Q' THEN period_end END) - min(CASE WHEN period_type = 'Q' THEN period_end END) BETWEEN 238 AND 308 THEN sum(CASE WHEN period_type = 'Q' THEN val END) ELSE max(CASE WHEN period_type = 'FY' AND rn = 1 THEN val END) END AS ttm FROM (SELECT *, row_number() OVER (PARTITION BY {k}, metric, period_type ORDER BY period_end DESC) AS rn FROM {p}f WHERE period_type IN ('Q', 'FY')) WHERE rn <= 4 GROUP BY {k}, metric",
        f"{p}instant": f"SELECT {k}, metric, val FROM {p}f WHERE period_type = 'INSTANT' QUALIFY row_number() OVER (PARTITION BY {k}, metric ORDER BY period_end DESC) = 1",
        f"{p}cagr": f"SELECT {k}, metric, CASE WHEN new > 0 AND old > 0 THEN (pow(new / old, 1.0 / 3) - 1) * 100 END AS cagr FROM (SELECT {k}, metric, max(CASE WHEN rn = 1 THEN val END) AS new, max(CASE WHEN rn = 4 THEN val END) AS old FROM (SELECT *, row_number() OVER (PARTITION BY {k}, metric ORDER BY period_end DESC) AS rn FROM {p}f WHERE period_type = 'FY') GROUP BY {k}, metric)",
        f"{p}price": price, f"{p}base": base,
        f"{p}wide": f"""SELECT b.*, x.price, t.revenue AS rev, t.operating_income AS oi, t.net_income AS ni, t.eps_diluted AS eps, t.operating_cash_flow AS ocf, t.capex AS capex, t.shares_diluted AS sd, coalesce(t.gross_profit, t.revenue - t.cost_of_revenue) AS gp, i.total_assets AS ta, i.total_equity AS te, i.cash AS ca, i.current_assets AS cua, i.current_liabilities AS cul,
 CASE WHEN i.short_term_debt IS NOT NULL OR i.long_term_debt IS NOT NULL THEN coalesce(i.short_term_debt, 0) + coalesce(i.long_term_debt, 0) END AS debt, x.price * coalesce(nullif(i.shares_outstanding, 0), t.shares_diluted) AS cap, round(g.revenue, 8) AS rg, round(g.eps_diluted, 8) AS eg
 FROM {p}base AS b LEFT JOIN (SELECT {k}, {pick(TTM_METRICS, 'ttm')} FROM {p}ttm GROUP BY {k}) AS t ON {on % (('t',) * on.count('%s'))} LEFT JOIN (SELECT {k}, {pick(INSTANTS, 'val')} FROM {p}instant GROUP BY {k}) AS i ON {on % (('i',) * on.count('%s'))}
 LEFT JOIN (SELECT {k}, {pick(['revenue', 'eps_diluted'], 'cagr')} FROM {p}cagr GROUP BY {k}) AS g ON {on % (('g',) * on.count('%s'))} LEFT JOIN {p}price AS x ON x.ticker = b.ticker{' AND x.as_of = b.as_of' if 'as_of' in k else ''}""",
        f"{p}snap": f"""SELECT {k}, ticker, name, sic_description, exchange{', data_age_days' if 'as_of' in k else ''}, price, cap AS market_cap, sd AS shares_diluted, rev AS revenue_ttm, gp AS gross_profit_ttm, oi AS operating_income_ttm, ni AS net_income_ttm, eps AS eps_ttm, ocf AS ocf_ttm, capex AS capex_ttm, ocf - abs(capex) AS fcf_ttm, ta AS total_assets, te AS total_equity, debt AS total_debt, ca AS cash,
 CASE WHEN eps > 0 THEN price / eps END AS pe, CASE WHEN te > 0 THEN cap / te END AS pb, cap / nullif(rev, 0) AS ps, cap + coalesce(debt, 0) - coalesce(ca, 0) AS ev, CASE WHEN oi > 0 THEN (cap + coalesce(debt, 0) - coalesce(ca, 0)) / oi END AS ev_to_ebit, CASE WHEN te > 0 THEN ni / te * 100 END AS roe, ni / nullif(ta, 0) * 100 AS roa, gp / nullif(rev, 0) * 100 AS gross_margin, oi / nullif(rev, 0) * 100 AS operating_margin, ni / nullif(rev, 0) * 100 AS net_margin,
 CASE WHEN te > 0 THEN debt / te END AS debt_to_equity, cua / nullif(cul, 0) AS current_ratio, rg AS revenue_cagr_3y, eg AS eps_cagr_3y FROM {p}wide""",
    }


_LATEST = "SELECT cik, unit, concept, period_start, period_end, val FROM facts QUALIFY row_number() OVER (PARTITION BY cik, unit, concept, period_start, period_end ORDER BY filed DESC, accn DESC, taxonomy DESC) = 1"
_DATES = "SELECT cik, period_start, period_end, max(filed) AS filed, min(filed) AS first_filed, arg_min(accn, concat(cast(filed AS varchar), accn)) AS first_accn FROM facts GROUP BY cik, period_start, period_end"
_LATEST_V = "SELECT v.as_of, f.cik, unit, concept, period_start, period_end, val FROM facts AS f JOIN vintages AS v ON f.filed <= v.as_of QUALIFY row_number() OVER (PARTITION BY v.as_of, f.cik, unit, concept, period_start, period_end ORDER BY filed DESC, accn DESC, taxonomy DESC) = 1"
_DATES_V = "SELECT v.as_of, f.cik, period_start, period_end, max(filed) AS filed, min(filed) AS first_filed, arg_min(accn, concat(cast(filed AS varchar), accn)) AS first_accn FROM facts AS f JOIN vintages AS v ON f.filed <= v.as_of GROUP BY v.as_of, f.cik, period_start, period_end"

CTES: dict[str, str] = {
    "facts": adapters.FACTS.format(**_T), "companies": adapters.COMPANIES.format(**_T), "prices": adapters.PRICES_DUCK.format(**_T), "members": adapters.MEMBERS.format(**_T), "headlines": adapters.HEADLINES.format(**_T), "vintages": adapters.VINTAGES,
    "concept_map": CONCEPTS_SQL, "metric_list": METRICS_SQL, "sic_ranges": SIC_SQL,
    "eps_pairs": f"SELECT cik, filed, period_start, period_end, old, val, CASE WHEN abs(old) >= abs(val) THEN 1 ELSE 0 END AS forward, greatest(abs(old / val), abs(val / old)) AS m FROM (SELECT *, lag(val) OVER (PARTITION BY cik, concept, period_start, period_end ORDER BY filed, accn) AS old FROM facts WHERE concept IN ({', '.join(repr(t) for t in EPS_TAGS)}) AND unit = 'USD/shares') WHERE old <> 0 AND val <> 0 AND sign(old) = sign(val)",
    "split_votes": f"SELECT cik, filed, CASE WHEN forward = 1 THEN r ELSE 1 / r END AS factor, count(DISTINCT (period_start, period_end)) AS n FROM (SELECT *, row_number() OVER (PARTITION BY p.cik, p.filed, p.period_start, p.period_end, p.old, p.val ORDER BY abs(m - r), r) AS rn FROM eps_pairs AS p CROSS JOIN (VALUES {', '.join(f'({float(r)})' for r in CLEAN_RATIOS)}) AS c(r)) WHERE rn = 1 AND abs(m - r) / r <= 0.03 GROUP BY cik, filed, CASE WHEN forward = 1 THEN r ELSE 1 / r END",
    "splits": "SELECT cik, min(filed) AS effective_filed, factor FROM (SELECT * FROM split_votes QUALIFY row_number() OVER (PARTITION BY cik, filed ORDER BY n DESC, factor) = 1) WHERE n >= 2 GROUP BY cik, factor",
    **_fundamentals("c_", "cik", _LATEST, _DATES, True),
    **_fundamentals("v_", "as_of, cik", _LATEST_V, _DATES_V, False),
    **_snapshot("c_", "cik", "SELECT f.cik, c.ticker, c.name, c.sic_description, c.exchange FROM (SELECT DISTINCT cik FROM c_f) AS f LEFT JOIN companies AS c ON f.cik = c.cik", "SELECT ticker, close AS price FROM prices QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1"),
    **_snapshot("v_", "as_of, cik", "SELECT u.as_of, u.cik, c.ticker, c.name, c.sic_description, c.exchange, u.as_of - u.newest AS data_age_days FROM (SELECT v.as_of, f.cik, max(f.filed) AS newest FROM facts AS f JOIN vintages AS v ON f.filed <= v.as_of GROUP BY v.as_of, f.cik) AS u LEFT JOIN companies AS c ON u.cik = c.cik", "SELECT v.as_of, p.ticker, p.close AS price FROM prices AS p JOIN vintages AS v ON p.date <= v.as_of QUALIFY row_number() OVER (PARTITION BY v.as_of, p.ticker ORDER BY p.date DESC) = 1"),
    "sectors": "SELECT c.*, coalesce(r.sector, 'Unclassified') AS sector, coalesce(r.sector_slug, 'unclassified') AS sector_slug FROM companies AS c LEFT JOIN sic_ranges AS r ON try_cast(c.sic AS int) BETWEEN r.lo AND r.hi QUALIFY row_number() OVER (PARTITION BY c.cik ORDER BY r.hi - r.lo NULLS LAST, r.lo) = 1",
    "bars": "SELECT ticker, date, close, volume, prev_close, (close / nullif(prev_close, 0) - 1) * 100 AS change_pct FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev_close FROM prices) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1",
    "banded": "SELECT *, CASE WHEN market_cap >= 200e9 THEN 'mega' WHEN market_cap >= 10e9 THEN 'large' WHEN market_cap >= 2e9 THEN 'mid' WHEN market_cap >= 300e6 THEN 'small' WHEN market_cap IS NOT NULL THEN 'micro' END AS band FROM c_snap",
    "flow_list": f"SELECT unnest([{', '.join(repr(m) for m in FLOWS)}]) AS metric", "stock_list": f"SELECT unnest([{', '.join(repr(m) for m in STOCKS)}]) AS metric", "annual_list": f"SELECT unnest([{', '.join(repr(m) for m in ANNUAL)}]) AS metric",
}


def oracle(select: str) -> str:
    """``select`` behind the common table expressions that it needs."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in need:
                    need.append(name)

    visit(select)
    return f"WITH {', '.join(f'{n} AS ({CTES[n]})' for n in need)} {select}" if need else select
