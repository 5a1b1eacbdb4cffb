"""Convergent-substitution analytics as Spark jobs.

Posterior substitution events on the branches of a rooted tree are a long fact
table (branch_id, site, grp, a, d, pp); everything else is joins, groupings and
windows over it.
"""
