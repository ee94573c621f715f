"""ledgerloom: operations analytics (sales, stock ledger, CRM, alerts) as Spark jobs.

Every public operator is a function ``DataFrame(s) -> DataFrame``; nothing is
collected to the driver. ``as_of`` is always an explicit argument so results
are reproducible (the web application this mirrors reads the wall clock).

Modules: ``operators.sales``, ``operators.inventory``, ``operators.listing``,
``operators.crm``, ``operators.requests``, ``operators.alerts``,
``operators.quality``, ``operators.commands``, ``operators.allocation``,
``streaming.jobs``; sources in ``sources.tables`` / ``sources.domain`` /
``sources.fixtures``; the driver registry in ``plans.registry``.
"""

from ledgerloom.session import (apply_cluster_settings, build_session,  # noqa: F401
                                checkpoint_dir)

__all__ = ["apply_cluster_settings", "build_session", "checkpoint_dir"]
