"""Text in images: boxes of an optical reader, which of them hold personal information, and their removal.

Readers and drawing libraries are plugged in; without one an image has no boxes and stays as it is.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmask.operators.detect import identifiers

BOX = "struct<text:string,x:int,y:int,w:int,h:int,confidence:double>"
#: Boxes at or under this confidence, in per cent, are noise.
LEAST = 30.0


def boxes(content: Column, reader: Callable[[bytes], list[dict]] | None = None) -> Column:
    """array<BOX> of an image; empty without a reader, for null, and where the reader fails."""

    def run(s: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> list[dict]:
            if data is None or reader is None:
                return []
            try:
                return [b for b in reader(bytes(data)) if b["confidence"] > LEAST and b["text"].strip()]
            except Exception:
                return []

        return s.map(one)

    return F.pandas_udf(run, f"array<{BOX}>")(content)


def personal_boxes(found: Column) -> Column:
    """The boxes whose own text holds an identifier; each box is looked at alone."""
    return F.filter(found, lambda b: F.size(identifiers(b["text"])) > 0)


def _hide(data: bytes | None, hidden: list[dict] | None, blur: float | None) -> bytes | None:
    if data is None or hidden is None or not len(hidden):
        return data
    try:
        from PIL import Image, ImageDraw, ImageFilter

        image = Image.open(io.BytesIO(data))
        form = image.format or "PNG"
        for b in hidden:
            x, y = max(0, b["x"]), max(0, b["y"])
            right, low = min(image.width, b["x"] + b["w"]), min(image.height, b["y"] + b["h"])
            if right <= x or low <= y:
                continue
            if blur is None:
                ImageDraw.Draw(image).rectangle([x, y, right - 1, low - 1], fill="black")
            else:
                image.paste(image.crop((x, y, right, low)).filter(ImageFilter.GaussianBlur(blur)), (x, y))
        out = io.BytesIO()
        image.save(out, format=form)
        return out.getvalue()
    except Exception:
        return data


def scan(images: DataFrame, reader: Callable[[bytes], list[dict]] | None = None, blur: float | None = None) -> DataFrame:
    """The images (any columns, one of them ``content``) with personal boxes blackened, or blurred by a radius.

    An image stays as it is where no drawing library is there, where it can't be read, or where it has no such box.
    """
    with_boxes = images.withColumn("_b", personal_boxes(boxes(F.col("content"), reader)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(content=[_hide(a, b, blur) for a, b in zip(pdf["content"], pdf["_b"])]).drop(columns="_b")

    return with_boxes.mapInPandas(run, images.schema)
