"""Lazy views of an image sequence: frames with their calibration.

A view holds an unexecuted relation (source_id, frame, ...), so chains of slices, channels,
crops and corrections cost nothing until a query runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celltide import model
from celltide.functions import units as U
from celltide.operators import registration


@dataclass(frozen=True)
class RotatedCropSpec:
    center: tuple[float, float]
    size: tuple[int, int]
    angle: float = 0.0

    def __post_init__(self):
        if any(isinstance(s, bool) or not isinstance(s, int) or s < 1 for s in self.size):
            raise ValueError("the crop size must be positive integers")


@dataclass(frozen=True)
class SequenceView:
    frames: DataFrame
    size_t: int
    pixel_size: float | tuple[float, float] | None = None
    frame_interval: tuple[float, str] | None = None
    timepoints: DataFrame | None = None
    channel: int | None = None

    def __len__(self) -> int:
        return self.size_t

    def __getitem__(self, key) -> SequenceView:
        """An integer gives one frame (negative from the end), a slice or a list a renumbered view."""
        if isinstance(key, slice):
            picked = list(range(self.size_t))[key]
        elif isinstance(key, (list, tuple)):
            picked = [self._position(k) for k in key]
        else:
            picked = [self._position(key)]
        steps = self.frames.sparkSession.createDataFrame([(p, i) for i, p in enumerate(picked)], "frame int, _new int")
        moved = lambda df: df.join(F.broadcast(steps), "frame").drop("frame").withColumnRenamed("_new", "frame").select(*df.columns)
        times = self.time_model()
        return replace(self, frames=moved(self.frames), size_t=len(picked), timepoints=None if times is None else moved(times), frame_interval=None)

    def _position(self, k: int) -> int:
        if not -self.size_t <= k < self.size_t:
            raise IndexError(f"frame {k} out of range for {self.size_t} frames")
        return k % self.size_t

    def time_model(self) -> DataFrame | None:
        """Explicit timepoints, else a regular grid, else None."""
        if self.timepoints is not None:
            return self.timepoints
        if self.frame_interval is None:
            return None
        return model.resolve_timepoints(self.frames.sparkSession, self.size_t, frame_interval=self.frame_interval[0], unit=self.frame_interval[1])

    def with_frame_interval(self, interval) -> SequenceView:
        return replace(self, frame_interval=U.to_quantity(interval), timepoints=None)

    def with_timepoints(self, timepoints: Sequence[float], unit: str = "second") -> SequenceView:
        points = model.resolve_timepoints(self.frames.sparkSession, self.size_t, timepoints=timepoints, unit=unit)
        return replace(self, timepoints=points, frame_interval=None)

    def with_pixel_size(self, pixel_size) -> SequenceView:
        return replace(self, pixel_size=pixel_size)

    def to_channel(self, channel: int) -> SequenceView:
        return replace(self, frames=self.frames.filter(F.col("channel") == channel) if "channel" in self.frames.columns else self.frames, channel=channel)

    def strided(self, step_y: int = 1, step_x: int = 1) -> SequenceView:
        """Every n-th pixel of a pixel relation (frame, y, x, ...)."""
        kept = self.frames.filter((F.col("y") % step_y == 0) & (F.col("x") % step_x == 0))
        kept = kept.withColumns({"y": (F.col("y") / step_y).cast("int"), "x": (F.col("x") / step_x).cast("int")})
        return replace(self, frames=kept, pixel_size=model.sliced_pixel_size(self.pixel_size, step_y, step_x))

    def crop(self, spec: RotatedCropSpec) -> SequenceView:
        from celltide.sources import sequences

        return replace(self, frames=sequences.rotated_crop(self.frames, spec.center, spec.size, spec.angle))

    def registered(self, transforms: DataFrame, on_missing: str = "warn") -> DataFrame:
        return registration.registered(self.frames, transforms, on_missing)

    def zipped(self, overlay: DataFrame) -> DataFrame:
        """frame and the detections of the frames both sides have."""
        return self.frames.select("frame").distinct().join(overlay, "frame")

    def materialize(self, path: str) -> SequenceView:
        """Written and read back: an executed copy."""
        self.frames.write.mode("overwrite").parquet(path)
        return replace(self, frames=self.frames.sparkSession.read.parquet(path))
