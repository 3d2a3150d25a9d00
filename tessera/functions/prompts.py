"""Prompts as columns: templates with {named} places, filled in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ANSWER = "Answer the question from the passages only. If they do not hold the answer, say that you do not know.\n\nQuestion:\n{question}\n\nWhat the reader wants:\n{intent}\n\nPassages:\n{context}"
ANALYSIS = 'Classify the question as RAG, CHAT or INVALID and rewrite it for retrieval. Reply with JSON: {{"question_type": "", "retrieval_query": "", "user_intent": "", "presentation_intent": ""}}\n\nQuestion:\n{question}'
CAPTION = "Describe what the image shows and all text in it, in Markdown, without remarks of your own."


def fill(template: str, **values: Column) -> Column:
    """The template with {name} replaced by values[name]; {{ and }} are braces; null values count as empty."""
    parts, at = [], 0
    for m in re.finditer(r"\{\{|\}\}|\{(\w+)\}", template):
        parts.append(F.lit(template[at:m.start()]))
        parts.append(F.coalesce(values[m[1]].cast("string"), F.lit("")) if m[1] else F.lit(m[0][0]))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))
