"""Session analytics as PySpark DataFrame operators.

Everything takes and returns DataFrames keyed by the entity id
(``mac_address``); nothing here collects fact rows to the driver.
"""

from roamlens.operators.dims import Dims

__all__ = ["Dims"]
