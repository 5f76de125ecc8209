"""What all results of a table say together: issues, risk, strengths, weaknesses, texts. Plain Python on small numbers."""

from __future__ import annotations

from collections.abc import Callable

LEVELS = {"none": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
RATIOS = ("duplicate_ratio", "near_duplicate_ratio", "outlier_ratio", "noise_ratio", "high_error_ratio")
COUNTS = ("num_columns_with_missing", "duplicate_groups", "cluster_count", "total_violations", "n_quality_issues")


def total_issues(summaries: dict[str, dict]) -> int:
    """1 for each ratio above 0, and the counts that components give."""
    n = 0
    for s in summaries.values():
        n += sum(1 for k in RATIOS if isinstance(s.get(k), (int, float)) and s[k] > 0)
        n += sum(int(s[k]) for k in COUNTS if isinstance(s.get(k), (int, float)))
    return n


def overall_risk(summaries: dict[str, dict]) -> str:
    """Half the largest and half the mean of the scores of risk levels (0 to 4) and ratios (1 to 3)."""
    scores = []
    for s in summaries.values():
        if s.get("risk_level") in LEVELS:
            scores.append(LEVELS[s["risk_level"]])
        scores += [3 if v > 0.2 else 2 if v > 0.1 else 1 if v > 0.05 else 0 for k, v in s.items() if "ratio" in k and isinstance(v, (int, float))]
    if not scores:
        return "unknown"
    level = (max(scores) + sum(scores) / len(scores)) / 2
    return next((name for name, least in (("critical", 3.5), ("high", 2.5), ("medium", 1.5), ("low", 0.5)) if level >= least), "none")


# From which number on a component's result is a strength or a weakness.
RULES: tuple[tuple[str, str, Callable[[float], bool], str, Callable[[float], bool], str], ...] = (
    ("exact_duplicates", "duplicate_ratio", lambda v: v == 0, "No row repeats another.", lambda v: v > 0.05, "Rows repeat each other."),
    ("missing_values", "num_columns_with_missing", lambda v: v <= 2, "Values are missing in two columns at most.", lambda v: v > 2, "Values are missing in several columns."),
    ("outliers", "outlier_ratio", lambda v: v < 0.05, "Few rows stand out from the others.", lambda v: v > 0.2, "Many rows stand out from the others."),
    ("label_noise", "noise_ratio", lambda v: v < 0.05, "Labels agree with what the columns say.", lambda v: v > 0.1, "Many labels are doubtful."),
    ("near_duplicates", "near_duplicate_ratio", lambda v: False, "", lambda v: v > 0.1, "Many rows nearly repeat others."),
    ("constraints", "total_violations", lambda v: v == 0, "Constraints hold.", lambda v: v > 5, "Several constraints are broken."),
    ("quality", "data_readiness_score", lambda v: v >= 0.8, "The table is ready for use.", lambda v: v < 0.6, "The table is not ready for use."),
)


def strengths_and_weaknesses(summaries: dict[str, dict], most: int = 3) -> tuple[list[str], list[str]]:
    good, bad = [], []
    for name, key, fine, praise, wrong, blame in RULES:
        v = summaries.get(name, {}).get(key)
        if isinstance(v, (int, float)) and not summaries[name].get("skipped"):
            if fine(v):
                good.append(praise)
            elif wrong(v):
                bad.append(blame)
    return good[:most], bad[:most]


def priorities(summaries: dict[str, dict], most: int = 3) -> list[str]:
    order = sorted((s for s in summaries.items() if s[1].get("risk_level") in ("high", "critical")), key=lambda s: -LEVELS[s[1]["risk_level"]])
    return [f"Look at {name.replace('_', ' ')} first: its risk is {s['risk_level']}." for name, s in order][:most]


def overview_text(summaries: dict[str, dict]) -> str:
    return "\n".join(f"- {name}: " + ", ".join(f"{k} {v}" for k, v in s.items() if isinstance(v, (int, float, str))) for name, s in summaries.items())


def dataset_summary(summaries: dict[str, dict], explain: Callable[[str], str] | None = None) -> dict:
    good, bad = strengths_and_weaknesses(summaries)
    plain = {
        "total_components_analyzed": len(summaries),
        "total_issues_detected": total_issues(summaries),
        "overall_risk_level": overall_risk(summaries),
        "strengths": good,
        "weaknesses": bad,
        "priorities": priorities(summaries),
    }
    text = explain(overview_text(summaries)) if explain else ""
    lines = [f"**Risk**: {plain['overall_risk_level']}. **Issues**: {plain['total_issues_detected']}."]
    lines += [f"- {x}" for x in (*good, *bad, *plain["priorities"])]
    return plain | {"summary": text or "\n".join(lines), "llm_summary_available": bool(text)}
