"""Chat formatting: conversations as marked text with a loss mask, in Spark expressions only.

The rows of a conversation are collected as structs and sorted; adjacent turns
of one role are merged into a block by array functions; blocks are concatenated.
Control strings inside texts are broken up by an escape character, so what is
written can be read back exactly, merged turns included.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths added up in one go; a longer list is added up in chunks.
CHUNK = 256


@dataclass(frozen=True)
class Template:
    """Control strings of a format: a block is opening, role, says, texts joined by ``more``, closing.

    All begin with one character that none holds again, and none holds the
    escape character: so no control string can begin inside another, nor in an
    escaped text that runs into one.
    """

    opening: str = "<turn>"
    says: str = "<says>"
    more: str = "<more>"
    closing: str = "</turn>\n"
    escape: str = "\\"
    learnt: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        lead, own = self.opening[:1], self.controls
        if not all(lead and c[:1] == lead and lead not in c[1:] and self.escape not in c and len(c) > 1 for c in own) or len(set(own)) < 4 or len(self.escape) != 1:
            raise ValueError("control strings must begin with one character that none of them holds again, differ, and be free of the escape character")
        if any(a != b and b.startswith(a) for a in own for b in own):
            raise ValueError("no control string may begin another")

    @property
    def controls(self) -> tuple[str, ...]:
        return self.opening, self.says, self.more, self.closing

    def _rest(self) -> str:
        return "|".join(re.escape(c[1:]) for c in self.controls)

    def escaped(self, text: Column) -> Column:
        """The text with the escape character doubled and each control string broken up after its first character."""
        lead, doubled = self.opening[0], F.replace(text, F.lit(self.escape), F.lit(2 * self.escape))
        return F.regexp_replace(doubled, f"{re.escape(lead)}(?={self._rest()})", _literal(lead + self.escape))

    def unescaped(self, text: Column) -> Column:
        lead, sign = re.escape(self.opening[0]), re.escape(self.escape)
        return F.regexp_replace(text, f"({sign}){sign}|({lead}){sign}(?={self._rest()})", "$1$2")


def _literal(text: str) -> str:
    """As a replacement that stands for itself."""
    return re.sub(r"([\\$])", r"\\\1", text)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` names it or runs it in a loop."""
    return F.element_at(F.transform(F.array(value), f), 1)


def starts(lengths: Column, chunk: int = CHUNK) -> Column:
    """For each of an array of lengths the sum of those before it; in two levels, so that long arrays stay cheap."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def before(values: Column, base: Column) -> Column:
        return F.aggregate(values, F.struct(base.alias("sum"), none.alias("out")), lambda acc, v: F.struct((acc["sum"] + v).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")))["out"]

    def of(values: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(1), F.size(values), F.lit(chunk)), lambda k: F.slice(values, k, chunk))
        sums = lambda all_: F.transform(all_, lambda c: F.aggregate(c, zero, lambda acc, v: acc + v))
        return let(chunks, lambda all_: let(before(sums(all_), zero), lambda bases: F.flatten(F.transform(all_, lambda c, k: before(c, F.get(bases, k))))))

    return let(lengths, lambda values: F.when(F.size(values) > 0, of(values)).otherwise(none))


def blocks(turns: Column) -> Column:
    """Array of (role, texts): runs of adjacent turns (role, text, in order) of one role."""
    role = lambda i: F.get(turns, i)["role"]
    first = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))

    def cut(at: Column) -> Column:
        end = lambda k: F.coalesce(F.get(at, k + 1), F.size(turns))
        return F.transform(at, lambda i, k: F.struct(role(i).alias("role"), F.transform(F.slice(turns, i + 1, end(k) - i), lambda t: t["text"]).alias("texts")))

    return let(first, cut)


def pieces(block: Column, template: Template) -> Column:
    """The segments of a block in order: (piece, loss), loss being those that are learnt."""
    plain = lambda x: F.struct(x.alias("piece"), F.lit(False).alias("loss"))
    learnt = block["role"].isin(*template.learnt)
    head = plain(F.concat(F.lit(template.opening), template.escaped(block["role"]), F.lit(template.says)))
    texts = F.transform(block["texts"], lambda t, k: F.array(plain(F.when(k == 0, "").otherwise(template.more)), F.struct(template.escaped(t).alias("piece"), learnt.alias("loss"))))
    return F.concat(F.array(head), F.flatten(texts), F.array(plain(F.lit(template.closing))))


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, formatted, loss_spans): a row a conversation.

    ``loss_spans`` (start, length; code points of ``formatted``) cover the
    texts of the learnt roles, one span a turn, control strings excluded.

    Turns are ordered by turn (null first), then role, then text; repeated rows
    are turns each. A null role or text is empty. Rows without conv_id are one
    conversation. Empty texts have a span of length 0 or more others beside
    them. An empty table gives no rows; other columns are ignored. A
    conversation is one value of the result, so it must fit a row (2 GB).
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select("conv_id", F.col("turn"), text("role"), text("text"))
    grouped = rows.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    whole = let(F.array_sort("turns"), lambda t: let(F.flatten(F.transform(blocks(t), lambda b: pieces(b, template))), lambda p: _joined(p)))
    return grouped.select("conv_id", whole.alias("whole")).select("conv_id", "whole.formatted", "whole.loss_spans")


def _joined(p: Column) -> Column:
    lengths = F.transform(p, lambda x: F.length(x["piece"]).cast("long"))
    spans = let(lengths, lambda n: F.filter(F.transform(F.arrays_zip(starts(n).alias("start"), n.alias("length"), p.alias("p")), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), x["p"]["loss"].alias("loss"))), lambda x: x["loss"]))
    return F.struct(F.array_join(F.transform(p, lambda x: x["piece"]), "").alias("formatted"), F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"))


def turns_of(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted conversation holds, in order."""
    cut = lambda x, by, most: F.split(x, re.escape(by), most)

    def of(block: Column) -> Column:
        def each(parts: Column) -> Column:
            role = template.unescaped(F.substring(F.get(parts, F.lit(0)), len(template.opening) + 1, 2**31 - 1))
            return let(role, lambda r: F.transform(cut(F.get(parts, F.lit(1)), template.more, -1), lambda t: F.struct(r.alias("role"), template.unescaped(t).alias("text"))))

        return let(cut(block, template.says, 2), each)

    return F.flatten(F.transform(F.filter(cut(formatted, template.closing, -1), lambda b: b != ""), of))


def learnt_text(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """What lies under the loss mask, unescaped and concatenated.

    Spans are cut from the four-byte form, in which a place is found without
    walking through the text before it.
    """
    piece = lambda wide, s: F.decode(F.substring(wide, (4 * s["start"] + 1).cast("int"), (4 * s["length"]).cast("int")), "UTF-32")
    return let(F.encode(formatted, "UTF-32"), lambda wide: F.array_join(F.transform(spans, lambda s: template.unescaped(piece(wide, s))), ""))


def read_back(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """Per formatted conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = chats.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), F.struct(turns_of(F.col("formatted"), template).alias("turns"), learnt_text(F.col("formatted"), F.col("loss_spans"), template).alias("learnt")).alias("r"))
    return each.select("conv_id", "formatted_chars", "r.turns", "r.learnt").select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars",
    )


def added_conversation(conv_id: int, turns: list[tuple[str, str]], spark) -> DataFrame:
    """A conversation given by (role, text), as rows of conversations."""
    row = lambda k, role, text: F.struct(F.lit(conv_id).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(text).alias("text"))
    return spark.range(1).select(F.inline(F.array(*[row(k, *t) for k, t in enumerate(turns)])))
