"""Box and cosmology parameters shared by every operator."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Box:
    """Periodic cube of side ``boxsize`` (Mpc/h) in a flat universe at scale factor ``a``."""

    boxsize: float
    omega_m: float = 0.273
    a: float = 1.0

    def __post_init__(self):
        if not self.boxsize > 0:
            raise ValueError(f"boxsize must be positive, got {self.boxsize}")
        if not self.omega_m > 0:
            raise ValueError(f"omega_m must be positive, got {self.omega_m}")
        if not self.a > 0:
            raise ValueError(f"a must be positive, got {self.a}")

    @classmethod
    def at_redshift(cls, boxsize: float, omega_m: float, z: float) -> "Box":
        return cls(boxsize, omega_m, 1.0 / (1.0 + z))

    @property
    def z(self) -> float:
        return 1.0 / self.a - 1.0

    @property
    def hubble(self) -> float:
        """H(a) in h km/s/Mpc."""
        return 100.0 * math.sqrt(self.omega_m / self.a**3 + 1.0 - self.omega_m)

    @property
    def aH(self) -> float:
        """Divide a peculiar velocity (km/s) by this to get a comoving displacement (Mpc/h)."""
        return self.a * self.hubble

    @property
    def volume(self) -> float:
        return self.boxsize**3


def parse_lambdas(text: str) -> list[float]:
    """``"0,0.5,1.0"`` -> ``[0.0, 0.5, 1.0]``."""
    values = [float(part) for part in text.split(",") if part.strip()]
    if not values:
        raise ValueError("no lambda value given")
    return values
