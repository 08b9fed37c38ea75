"""Training-data operators (see README, section "Training-data operators")."""
