"""Physical constants and the settings that follow from an observing frequency."""

from __future__ import annotations

import math
from dataclasses import dataclass

# Lunar radius and orbit altitude (m), longest baseline (m), wave speed (m/s), and the weights' bounds.
MOON_RADIUS = 1_737_100.0
ALTITUDE = 300_000.0
LONGEST_BASELINE = 100_000.0
WAVE_SPEED = 3e8
WEIGHT_CAP = 0.125
INNER_WEIGHT = 1 / (4 * math.pi)


@dataclass(frozen=True)
class Observation:
    """Settings at one frequency (Hz)."""

    frequency: float = 1e6

    @property
    def wavelength(self) -> float:
        return WAVE_SPEED / self.frequency

    @property
    def shells(self) -> int:
        """Half-wavelength shells up to the longest baseline."""
        return math.ceil(LONGEST_BASELINE / self.wavelength * 2)

    @property
    def open_angle(self) -> float:
        """Greatest angle from a satellite's outward direction that the Moon leaves free."""
        return math.pi - math.asin(MOON_RADIUS / (MOON_RADIUS + ALTITUDE))


def settings(observation: Observation, nside: int) -> list[tuple[str, float]]:
    """Names and values that a job logs before it starts."""
    blind = math.pi - observation.open_angle
    return [
        ("nside", float(nside)), ("npix", float(nside_to_npix(nside))), ("resolution_degrees", resolution_degrees(nside)),
        ("theta", blind), ("phi", observation.open_angle), ("wavelength", observation.wavelength), ("shells", float(observation.shells)),
    ]


def nside_to_npix(nside: int) -> int:
    return 12 * nside * nside


def npix_to_nside(npix: int) -> int:
    nside = round(math.sqrt(npix // 12))
    if nside_to_npix(nside) != npix:
        raise ValueError(f"{npix} is not a pixel count")
    return nside


def resolution_degrees(nside: int) -> float:
    """Mean pixel width."""
    return math.degrees(math.sqrt(4 * math.pi / nside_to_npix(nside)))


def pixel_area(npix: int) -> float:
    return 4 * math.pi / npix
