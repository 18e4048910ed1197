"""Every operator as a query; each of these modules registers its own in ``catalog.QUERIES``."""

from pitchflow.plans import catalog, clips, drawing, media, pixels  # noqa: F401
