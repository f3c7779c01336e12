"""String-building Column helpers: template filling and entity-span marking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import let

PLACEHOLDER = "{}"


def fill_template(template: str, *values: Column) -> Column:
    """Fill the ``{}`` placeholders of ``template`` in order with ``values``.

    Built as one ``concat`` of literal pieces and columns, so it stays inside whole-stage
    codegen and needs no escaping of ``%`` as ``format_string`` would.
    """
    pieces = template.split(PLACEHOLDER)
    if len(pieces) - 1 != len(values):
        raise ValueError(
            f"template {template!r} has {len(pieces) - 1} placeholders, got {len(values)} values"
        )
    parts: list[Column] = []
    for i, piece in enumerate(pieces):
        if piece:
            parts.append(F.lit(piece))
        if i < len(values):
            parts.append(values[i])
    return F.concat(*parts)


def slice_from(s: Column, start: Column) -> Column:
    """Python ``s[start:]`` for a non-negative code-point offset."""
    return s.substr(start + 1, F.greatest(F.length(s) - start, F.lit(0)))


def slice_to(s: Column, stop: Column) -> Column:
    """Python ``s[:stop]`` for a non-negative code-point offset."""
    return s.substr(F.lit(1), F.greatest(stop, F.lit(0)))


def slice_between(s: Column, start: Column, stop: Column) -> Column:
    """Python ``s[start:stop]`` for non-negative code-point offsets (empty when stop <= start)."""
    return s.substr(start + 1, F.greatest(stop - start, F.lit(0)))


def mark_spans(
    sentence: Column, e1_s: Column, e1_e: Column, e2_s: Column, e2_e: Column
) -> Column:
    """Insert ``[E{n}]`` before the 1st and 3rd and ``[/E{n}]`` after the 2nd and 4th offset.

    The four offsets (end inclusive) are ordered by position with ties kept in the order
    e1_s, e1_e, e2_s, e2_e; ``n`` is the entity the ordered offset belongs to.  Overlapping
    spans therefore give crossed tags and touching spans repeat the shared character, exactly
    as the slicing rule does.
    """
    points = F.array_sort(
        F.array(
            F.struct(e1_s.alias("pos"), F.lit(0).alias("ord"), F.lit(1).alias("ent")),
            F.struct(e1_e.alias("pos"), F.lit(1).alias("ord"), F.lit(1).alias("ent")),
            F.struct(e2_s.alias("pos"), F.lit(2).alias("ord"), F.lit(2).alias("ent")),
            F.struct(e2_e.alias("pos"), F.lit(3).alias("ord"), F.lit(2).alias("ent")),
        )
    )
    return let(points, lambda pts: _marked(sentence, pts))


def _marked(sentence: Column, pts: Column) -> Column:
    """Fold over the ordered points with a cursor: an odd point writes the text before it and an
    opening tag, an even point writes its text up to and including it and a closing tag."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(True).alias("opens"))

    def step(acc, p):
        stop = F.when(acc["opens"], p["pos"]).otherwise(p["pos"] + 1)
        tag = F.concat(F.when(acc["opens"], "[E").otherwise("[/E"), p["ent"].cast("string"), F.lit("]"))
        return F.struct(
            F.concat(acc["out"], slice_between(sentence, acc["at"], stop), tag).alias("out"),
            # an opening tag always leaves the cursor on its point, even if that steps back
            stop.alias("at"),
            (~acc["opens"]).alias("opens"),
        )

    return F.aggregate(
        pts, start, step, lambda acc: F.concat(acc["out"], slice_from(sentence, acc["at"]))
    )


def spans_overlap(e1_s: Column, e1_e: Column, e2_s: Column, e2_e: Column) -> Column:
    """True when the two inclusive spans share at least one position."""
    return (e1_s <= e2_e) & (e2_s <= e1_e)
