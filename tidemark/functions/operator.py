"""Relational operators: one statement over named input frames, planned by Catalyst.

An Operator is called with DataFrames and gives a DataFrame; nothing is collected. Its text is plain SQL
over the names of its inputs, so another engine can run the same definition on views of those names.
Three things are spelled differently there: DAYS(a, b), whole days from b to a; JSON(text, key), a value of a
JSON object; and sha256(text).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame


def doubles(text: str) -> str:
    """Literals with a point as doubles, which Spark would take for decimals."""
    return re.sub(r"(?<![\w.'])(\d*\.\d+)(?![\w'])", r"\1D", text)


@dataclass(frozen=True)
class Operator:
    name: str
    inputs: tuple[str, ...]
    text: str
    about: str

    def __call__(self, *frames: DataFrame) -> DataFrame:
        if len(frames) != len(self.inputs):
            raise TypeError(f"{self.name} takes {', '.join(self.inputs)}")
        text = re.sub(r"DAYS\(([^,()]+), ([^()]+)\)", r"datediff(cast(\1 as date), cast(\2 as date))", self.text)
        text = re.sub(r"JSON\((\w+), (\w+)\)", r"get_json_object(\1, '$.\2')", text)
        text = re.sub(r"sha256\((concat\((?:[^()]|\([^()]*\))*\))\)", r"sha2(\1, 256)", text)
        text = doubles(text)
        for name in self.inputs:
            text = re.sub(rf"\b(from|join) {name}\b", rf"\1 {{{name}}} as {name}", text)
        return frames[0].sparkSession.sql(text, **dict(zip(self.inputs, frames)))

    def portable(self, views: dict[str, str]) -> str:
        """The text for an engine with day arithmetic of its own, its views as common table expressions."""
        text = re.sub(r"DAYS\(([^,()]+), ([^()]+)\)", r"cast(date_diff('day', cast(\2 as date), cast(\1 as date)) as integer)", self.text)
        text = re.sub(r"JSON\((\w+), (\w+)\)", r"json_extract_string(\1, '$.\2')", text)
        with_ = ", ".join(f"{n} as ({text})" for n, text in views.items())
        if not with_:
            return text
        rest = text.lstrip()
        return f"with {with_}, {rest[5:]}" if rest.startswith("with ") else f"with {with_} {rest}"


def operator(name: str, inputs: str, about: str, text: str) -> Operator:
    return Operator(name, tuple(inputs.split()), text.strip(), about)
