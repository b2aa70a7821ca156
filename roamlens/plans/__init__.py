"""Catalogues: documented labeling functions, levels and registered queries."""
