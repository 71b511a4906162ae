"""Boxes between the image that was recognised and the original page.

Recognition runs on a prepared image (straightened, then resized), the model sees the original.
Boxes therefore name their ``coordinate_space``, and nothing joins boxes of two spaces: a line, page
or document that would mix them has no boxes and says so in ``space_error``.

A transform is one row a page: the affine map ``x' = a x + b y + c``, ``y' = d x + e y + f`` from the
prepared image to the original.  A turned box becomes the least upright box around its corners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREPARED, ORIGINAL = "preprocessed", "original"
MIXED_SPACES = "boxes of several coordinate spaces"
NO_TRANSFORM = "no transform from {} to {}"
_MAP = ("a", "b", "c", "d", "e", "f")
_PAGE = ("document_id", "page_number")


def page_transforms(pages: DataFrame) -> DataFrame:
    """Transforms back to the original: document_id, page_number, from_space, to_space, a to f.

    ``pages`` has width and height of the original, rotation (degrees by which its content was
    turned counter-clockwise about the middle, canvas kept; null: none) and scale_x, scale_y (size
    of the prepared image over that of the original).  Pages without sizes or with a scale of zero
    have no transform; of repeated pages the least row counts.
    """
    turn = F.radians(F.coalesce(F.col("rotation").cast("double"), F.lit(0.0)))
    cos, sin, x, y = F.cos(turn), F.sin(turn), F.col("width") / 2, F.col("height") / 2
    sx, sy = F.col("scale_x").cast("double"), F.col("scale_y").cast("double")
    # prepared = scale * (turn about the middle); back: unscale, turn the other way about the middle
    maps = pages.select(*_PAGE, (cos / sx).alias("a"), (-sin / sy).alias("b"), (x - cos * x + sin * y).alias("c"),
                        (sin / sx).alias("d"), (cos / sy).alias("e"), (y - sin * x - cos * y).alias("f"), "scale_x", "scale_y")
    whole = maps.filter("scale_x <> 0 and scale_y <> 0").dropna(subset=list(_MAP))
    return whole.groupBy(*_PAGE).agg(F.min(F.struct(*_MAP)).alias("m")).select(
        *_PAGE, F.lit(PREPARED).alias("from_space"), F.lit(ORIGINAL).alias("to_space"), "m.*")


def _mapped(box: Column, m: str) -> Column:
    x, y = ((F.get(box, F.lit(0)), F.get(box, F.lit(2))), (F.get(box, F.lit(1)), F.get(box, F.lit(3))))
    corner = lambda i, j, p, q, r: F.round(F.col(f"{m}.{p}") * x[i] + F.col(f"{m}.{q}") * y[j] + F.col(f"{m}.{r}"), 6)
    xs, ys = ([corner(i, j, *names) for i in (0, 1) for j in (0, 1)] for names in ("abc", "def"))
    return F.array(F.floor(F.least(*xs)), F.floor(F.least(*ys)), F.ceil(F.greatest(*xs)), F.ceil(F.greatest(*ys))).cast("array<int>")


def to_space(boxes: DataFrame, transforms: DataFrame, space: str = ORIGINAL, box: str = "bbox") -> DataFrame:
    """Boxes in the wanted space; coordinate_space says so.

    Rows already there stay as they are.  A row without transform, or one that mixes spaces (its
    coordinate_space is null), loses its box and has ``space_error``.
    """
    own = F.col("coordinate_space")
    known = transforms.filter(F.col("to_space") == space).select(*_PAGE, F.col("from_space").alias("coordinate_space"), F.struct(*_MAP).alias("_map"))
    joined = boxes.join(known, [*_PAGE, "coordinate_space"], "left")
    before, middle, after = NO_TRANSFORM.split("{}")
    lacking = F.when(own.isNull(), MIXED_SPACES).when((own != space) & F.col("_map").isNull(), F.concat(
        F.lit(before), own, F.lit(middle + space + after)))
    error = F.coalesce(F.col("space_error"), lacking) if "space_error" in boxes.columns else lacking
    kept = [c for c in boxes.columns if c not in (box, "coordinate_space", "space_error")]
    return joined.select(
        *kept, F.when(error.isNull(), F.when(own == space, F.col(box)).otherwise(_mapped(F.col(box), "_map"))).alias(box),
        F.when(error.isNull(), space).alias("coordinate_space"), error.alias("space_error"))


def one_space(rows: DataFrame) -> dict[str, Column]:
    """Aggregates that carry the space of grouped rows: coordinate_space, null with a space_error if they differ.

    Rows without the column hold what recognition gives, prepared coordinates.
    """
    if "coordinate_space" not in rows.columns:
        return {"coordinate_space": F.lit(PREPARED), "space_error": F.lit(None).cast("string")}
    own = F.coalesce("coordinate_space", F.lit(""))  # a member that mixes spaces mixes the group
    mixed = (F.min(own) != F.max(own)) | (F.min(own) == "")
    known = F.min("space_error") if "space_error" in rows.columns else F.lit(None).cast("string")
    return {"coordinate_space": F.when(~mixed, F.min(own)), "space_error": F.when(mixed, F.coalesce(known, F.lit(MIXED_SPACES)))}
