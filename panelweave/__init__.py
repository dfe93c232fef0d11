"""Panel analytics on Spark: operators over (entity, period) tables as DataFrame plans."""

from panelweave.spec import PanelSpec

__all__ = ["PanelSpec"]
