"""A standalone HTML report: no scripts, no network; charts are inline SVG."""

from __future__ import annotations

from html import escape

from assay.report.explain import WHY

STYLE = "body{font:15px/1.5 system-ui,sans-serif;max-width:60rem;margin:2rem auto;padding:0 1rem;color:#222}table{border-collapse:collapse;margin:.5rem 0}td,th{border:1px solid #ccc;padding:.2rem .6rem;text-align:left}nav a{margin-right:1rem}section{border-top:1px solid #ddd;margin-top:2rem}.skipped{color:#777}"
RATIO_WORDS, COUNT_WORDS = ("ratio", "share"), ("rows", "count", "groups", "pairs", "violations")


def value_text(key: str, value, n_rows: int | None) -> str:
    """Ratios as percent with rows, counts with their percent of rows, lists by their first five."""
    if isinstance(value, bool) or value is None:
        return escape(str(value))
    if isinstance(value, (int, float)) and any(w in key for w in RATIO_WORDS):
        return f"{value:.1%}" + (f" ({round(value * n_rows)} of {n_rows} rows)" if n_rows and 0 <= value <= 1 else "")
    if isinstance(value, int) and key.endswith("rows") and n_rows and key != "n_rows":
        return f"{value} ({value / n_rows:.1%} of {n_rows} rows)"
    if isinstance(value, float):
        return f"{value:.4g}"
    if isinstance(value, dict):
        return "<table>" + "".join(f"<tr><th>{escape(str(k))}</th><td>{value_text(str(k), v, n_rows)}</td></tr>" for k, v in value.items()) + "</table>"
    if isinstance(value, (list, tuple)):
        shown = "".join(f"<li>{value_text(key, v, n_rows)}</li>" for v in value[:5])
        return f"<ul>{shown}</ul>" + (f"and {len(value) - 5} more" if len(value) > 5 else "") if value else "none"
    return markdown(str(value))


def markdown(text: str) -> str:
    """Bold marks, list marks and line ends of a plain text."""
    out, listed = [], False
    for line in text.split("\n"):
        parts = escape(line.removeprefix("- ")).split("**")
        body = "".join(f"<b>{p}</b>" if i % 2 and i < len(parts) - 1 else p for i, p in enumerate(parts))
        if line.startswith("- ") != listed:
            out.append("</ul>" if listed else "<ul>")
            listed = not listed
        out.append(f"<li>{body}</li>" if listed else f"{body}<br>" if body else "")
    return "".join(out).removesuffix("<br>") + ("</ul>" if listed else "")


def bars(title: str, values: dict[str, float], most: float | None = None) -> str:
    """A horizontal bar chart."""
    shown = {k: v for k, v in values.items() if isinstance(v, (int, float)) and v > 0}
    if not shown:
        return ""
    top, rows = most or max(shown.values()), []
    for i, (k, v) in enumerate(shown.items()):
        width = 300 * min(1, v / top)
        rows.append(f'<text x="190" y="{i * 24 + 16}" text-anchor="end">{escape(str(k))[:28]}</text><rect x="200" y="{i * 24 + 4}" width="{width:.1f}" height="16" fill="#4a78b5"/><text x="{206 + width:.1f}" y="{i * 24 + 16}">{v:.4g}</text>')
    return f'<figure><figcaption>{escape(title)}</figcaption><svg role="img" width="600" height="{24 * len(shown) + 8}" font-size="12">{"".join(rows)}</svg></figure>'


def chart_data(results: dict[str, dict]) -> dict[str, dict[str, float]]:
    """Numbers for the charts, by title; only what is above 0."""
    get = lambda c, k: results.get(c, {}).get(k)
    out: dict[str, dict[str, float]] = {}
    out["Missing values, %"] = {w["column"]: round(100 * w["missing_ratio"], 2) for w in get("missing_values", "worst_columns") or []}
    out["Columns by type"] = get("overview", "dtypes") or {}
    out["Rows that stand out, %"] = {k: round(100 * v, 2) for k, v in (("numeric", get("outliers", "outlier_ratio") or 0), ("categorical", get("categorical_outliers", "outlier_ratio") or 0))}
    score = get("constraints", "consistency_score")
    parts = (("exact duplicates", get("exact_duplicates", "duplicate_ratio")), ("near duplicates", get("near_duplicates", "near_duplicate_ratio")), ("doubtful labels", get("label_noise", "noise_ratio")), ("anomalies", get("reconstruction", "high_error_ratio")), ("inconsistency", None if score is None else 1 - score), ("readiness", get("quality", "data_readiness_score")))
    out["Quality, share"] = {k: round(v, 4) for k, v in parts if v}
    return {k: {n: x for n, x in v.items() if x > 0} for k, v in out.items()}


def section(name: str, result: dict, n_rows: int | None) -> str:
    title = escape(name.replace("_", " ").capitalize())
    if result.get("status") == "failed" or result.get("skipped"):
        return f'<section id="{name}"><h2>{title}</h2><p class="skipped">Analysis failed or skipped: {escape(str(result.get("reason", "")))}</p></section>'
    rows = "".join(f"<tr><th>{escape(k.replace('_', ' '))}</th><td>{value_text(k, v, n_rows)}</td></tr>" for k, v in result.items() if k not in ("explanation", "status"))
    said = f"<p>{markdown(result['explanation'])}</p>" if result.get("explanation") else ""
    return f'<section id="{name}"><h2>{title}</h2><p>{escape(WHY.get(name, ""))}</p><table>{rows}</table>{said}</section>'


def render(results: dict[str, dict], title: str = "Data quality report") -> str:
    n_rows = results.get("overview", {}).get("n_rows")
    links = "".join(f'<a href="#{n}">{escape(n.replace("_", " "))}</a>' for n in results)
    charts = "".join(bars(k, v) for k, v in chart_data(results).items())
    body = "".join(section(n, r, n_rows) for n, r in results.items())
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title><style>{STYLE}</style></head><body><h1>{escape(title)}</h1><nav>{links}</nav>{charts}{body}</body></html>'


def write(results: dict[str, dict], path: str, title: str = "Data quality report") -> str:
    with open(path, "w", encoding="utf-8") as f:
        f.write(render(results, title))
    return path
