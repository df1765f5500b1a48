"""martforge: a Spark-native commerce warehouse.

Change capture -> keyed staging -> cleaned layer -> marts, plus the shop's
questions as set-based operators. Entry points:

* ``session.build_session`` / ``session.configure`` -- session settings;
* ``sources.cdc`` -- change sources, decode, unwrap, route;
* ``operators`` -- staging upsert, cleaning loads, marts, shop, orders,
  carts, customers, quality checks;
* ``plans.refresh.refresh`` -- the guarded, versioned full refresh;
* ``streaming.cdc_stream`` / ``streaming.cart_state`` -- continuous forms.
"""

from .session import build_session, configure

__all__ = ["build_session", "configure"]
