"""NetCDF is not implemented, and the error says so."""

import pytest
from gridtide.sources.standardize import open_sources


def test_netcdf_is_not_implemented():
    with pytest.raises(ImportError, match="not implemented"):
        open_sources(None, ["x"], "netcdf")
