"""Legendre polynomials and shell volumes as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column


def p2(nu2: Column) -> Column:
    return 1.5 * nu2 - 0.5


def p3(nu: Column) -> Column:
    return 0.5 * (5.0 * nu * nu - 3.0) * nu


def p4(nu2: Column) -> Column:
    return 0.125 * (35.0 * nu2 * nu2 - 30.0 * nu2 + 3.0)


def shell_volume(lower: Column, upper: Column) -> Column:
    return (4.0 * math.pi / 3.0) * (upper * upper * upper - lower * lower * lower)
