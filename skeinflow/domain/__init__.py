"""Analyses of experimental data: eye movements, trajectories, curves, spikes, selectivity and the like."""
