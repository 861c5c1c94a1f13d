from .views import VIEWS, JdbcSource, load_views

__all__ = ["VIEWS", "JdbcSource", "load_views"]
