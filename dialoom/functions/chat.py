"""Chat formats by name: how turns of a conversation, frames among them, are written for a model."""

from __future__ import annotations

from abc import ABC, abstractmethod
from typing import ClassVar

from pyspark.sql import Column
from pyspark.sql import functions as F


class ChatFormat(ABC):
    """A format over turns (role, content, start, end); subclasses register themselves by ``name``."""

    registry: ClassVar[dict[str, type[ChatFormat]]] = {}
    name: ClassVar[str] = ""
    start: ClassVar[str] = ""

    def __init__(self, image: str = "<image>", per_image: int = 1, separator: str = ""):
        self.image, self.per_image, self.separator = image, per_image, separator

    def __init_subclass__(cls) -> None:
        if cls.name:
            ChatFormat.registry[cls.name] = cls

    @abstractmethod
    def said(self, turn: Column) -> Column:
        """A turn of text."""

    def images(self, n: Column) -> Column:
        return F.array_join(F.array_repeat(F.lit(self.image * self.per_image), n.cast("int")), self.separator)

    def message(self, turn: Column) -> Column:
        return F.when(turn["role"] == "frames", self.images(turn["end"] - turn["start"])).otherwise(self.said(turn))

    def text(self, turns: Column) -> Column:
        return F.concat(F.lit(self.start), F.array_join(F.transform(turns, self.message), ""))

    def learn_ranges(self, turns: Column) -> Column:
        """Ranges [start, end) of the text's characters that are learned: whole assistant turns, and of each frame but a turn's last what tells it from the next, the separator or else the next image's first token."""
        block = len(self.image) * self.per_image + len(self.separator)
        width = len(self.separator) or len(self.image)
        zero = F.struct(F.lit(len(self.start)).alias("at"), F.array().cast("array<array<int>>").alias("ranges"))

        def step(acc: Column, turn: Column) -> Column:
            n = (turn["end"] - turn["start"]).cast("int")
            length = F.length(self.message(turn))
            shown = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array(acc["at"] + i * block - len(self.separator), acc["at"] + i * block - len(self.separator) + width))).otherwise(F.array().cast("array<array<int>>"))
            own = F.when(turn["role"] == "frames", shown).when(turn["role"] == "assistant", F.array(F.array(acc["at"], acc["at"] + length))).otherwise(F.array().cast("array<array<int>>"))
            return F.struct((acc["at"] + length).alias("at"), F.concat(acc["ranges"], own).alias("ranges"))

        return F.aggregate(turns, zero, step, lambda acc: acc["ranges"])


class HeaderChat(ChatFormat):
    """Each turn behind a header with its role, and an end mark."""

    name = "headers"
    # The marks of the model's vocabulary.
    start, head, head_end, end = "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>"

    def said(self, turn: Column) -> Column:
        return F.concat(F.lit(self.head), turn["role"], F.lit(self.head_end), F.regexp_replace(turn["content"], r"^\s+|\s+$", ""), F.lit(self.end))


class PlainChat(ChatFormat):
    """``Role: text`` lines."""

    name = "plain"

    def said(self, turn: Column) -> Column:
        return F.concat(F.initcap(turn["role"]), F.lit(": "), F.regexp_replace(turn["content"], r"^\s+|\s+$", ""), F.lit("\n"))


def chat_format(name: str, **options: object) -> ChatFormat:
    """A format by its name; an unknown one is an error."""
    if name not in ChatFormat.registry:
        raise KeyError(f"no chat format {name}; there are {sorted(ChatFormat.registry)}")
    return ChatFormat.registry[name](**options)
