"""Texts about results. The default makes them from templates; anything with ``generate(prompt)`` can be put in its place."""

from __future__ import annotations

from typing import Protocol

EXAMPLES = 5


class TextModel(Protocol):
    def generate(self, prompt: str) -> str: ...


class Explainer:
    """Templates, or a model's words where one is given and enabled; a model that fails falls back to the template."""

    _shared: Explainer | None = None

    def __init__(self, model: TextModel | None = None):
        self.model, self.enabled = model, True

    @classmethod
    def shared(cls, model: TextModel | None = None) -> Explainer:
        if cls._shared is None or model is not None:
            cls._shared = cls(model)
        return cls._shared

    def enable(self) -> None:
        self.enabled = True

    def disable(self) -> None:
        self.enabled = False

    @property
    def available(self) -> bool:
        return self.enabled and self.model is not None

    def say(self, prompt: str, template: str) -> str:
        if self.available:
            try:
                return self.model.generate(prompt).strip() or template
            except Exception:  # a text is no reason to lose a report
                return template
        return template

    def outlier(self, row: dict, score: float, features: dict[str, float]) -> str:
        most = ", ".join(f"{k} ({v:.2f})" for k, v in list(features.items())[:EXAMPLES])
        return self.say(f"Explain why this row is an outlier: {row}; score {score}; features {features}", f"The row's score is {score:.3f}; what sets it apart most: {most or 'no single feature'}.")

    def near_duplicate(self, one: dict, other: dict, similarity: float, matching: list[str]) -> str:
        return self.say(f"Explain why {one} and {other} are near-duplicates ({similarity})", f"The rows are {similarity:.1%} alike and agree in {', '.join(matching) or 'no column entirely'}.")

    def anomaly(self, error: float, features: dict[str, float]) -> str:
        most = ", ".join(list(features)[:EXAMPLES])
        return self.say(f"Explain a reconstruction error of {error}: {features}", f"The row can't be rebuilt from the others (error {error:.3f}), least of all {most or 'no single feature'}.")

    def label_noise(self, label, likely, score: float) -> str:
        strength = "very likely" if score > 1.2 else "likely" if score > 0.8 else "possibly"
        return f"The label {label} is {strength} wrong; {likely} fits the other columns better."

    def component(self, name: str, summary: dict) -> str:
        known = ", ".join(f"{k.replace('_', ' ')} {v}" for k, v in summary.items() if isinstance(v, (int, float, str)) and not isinstance(v, bool))
        return self.say(f"Summarise the results of {name}: {summary}", f"{name.replace('_', ' ').capitalize()}: {known or 'nothing to report'}.")

    def dataset(self, text: str) -> str:
        return self.say(f"Summarise the quality of this table:\n{text}", "") if self.available else ""


WHY = {
    "overview": "Shape, types and cardinality show what kind of table this is and which columns identify rows.",
    "missing_values": "Missing values bias what is computed from the rest and break models that need complete rows.",
    "exact_duplicates": "Repeated rows count twice and leak from training into test sets.",
    "near_duplicates": "Rows that nearly repeat others do the same harm and escape an exact comparison.",
    "outliers": "Rows unlike all others are errors, or the most interesting rows of the table.",
    "categorical_outliers": "Very rare categories are often typing errors.",
    "reconstruction": "Rows that a compressed description of the table can't rebuild break its joint pattern.",
    "label_noise": "Wrong labels limit every model that learns from them.",
    "constraints": "Rules between columns show errors that no single column shows.",
    "quality": "One score makes tables comparable; its parts say where work pays.",
    "summary": "All results in one place, ordered by what to do first.",
}
