"""Reusable DataFrame -> DataFrame operators.

Canonical column names, used by every operator:

* residency: ``entity, location, status, period, period_start, period_end, tie``;
* sightings: ``entity, period, date, location``;
* periods:   ``period, period_start, period_end``;
* movement:  the columns listed in ``plans.movement_table``.

``tie`` is a unique number that makes "first" and "last" reproducible.
"""
