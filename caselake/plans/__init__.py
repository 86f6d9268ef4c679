from . import global_daily, portal, province, reports, serving, timeline, vaccination  # noqa: F401
