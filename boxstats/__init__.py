"""Two-point statistics of particle catalogues in a periodic box, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from boxstats.box import Box, parse_lambdas
from boxstats.operators.charfn import characteristic_function, velocity_dispersion
from boxstats.operators.fof import fof_groups, fof_halos, group_velocity, linking_length
from boxstats.operators.fourier import fft_mesh
from boxstats.operators.histogram import hist_1d, hist_2d, pdf_1d
from boxstats.operators.mesh import cic_density, cic_momentum, density_contrast
from boxstats.operators.nearest import knn, nearest_velocity
from boxstats.operators.pairs import (
    count_pairs,
    pair_bins,
    pair_dduu,
    pair_uu,
    xi_dd,
    xi_monopole,
)
from boxstats.operators.smoothing import smooth_velocity
from boxstats.operators.spectra import (
    modes,
    power_2d,
    power_decomposed,
    power_matter,
    subtract_fields,
)
from boxstats.operators.transforms import (
    bounding_box,
    displacement,
    mass_cut,
    redshift_space,
    subsample,
    velocity_to_kms,
    wrap_positions,
)
from boxstats.sources.catalog import Catalog, read_catalog, write_catalog
from boxstats.sources.randoms import randoms

__all__ = [
    "Box",
    "Catalog",
    "bounding_box",
    "characteristic_function",
    "cic_density",
    "cic_momentum",
    "count_pairs",
    "density_contrast",
    "displacement",
    "fft_mesh",
    "fof_groups",
    "fof_halos",
    "group_velocity",
    "hist_1d",
    "hist_2d",
    "knn",
    "linking_length",
    "mass_cut",
    "modes",
    "nearest_velocity",
    "pair_bins",
    "pair_dduu",
    "pair_uu",
    "parse_lambdas",
    "pdf_1d",
    "power_2d",
    "power_decomposed",
    "power_matter",
    "randoms",
    "read_catalog",
    "redshift_space",
    "smooth_velocity",
    "subsample",
    "subtract_fields",
    "velocity_dispersion",
    "velocity_to_kms",
    "wrap_positions",
    "write_catalog",
    "xi_dd",
    "xi_monopole",
]

# Tasks carry the small helpers they run, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
