"""Logical plans of ordered, typed tables."""

from plumbline.plans.ordered import ORD, Plan

__all__ = ["ORD", "Plan"]
