"""Distributed fits. A fitted model is a set of factor or weight tables."""
