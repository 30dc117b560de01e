"""Streaming twins of the timeline and the tracker."""
