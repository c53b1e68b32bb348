"""The three layers as DataFrame plans, and the batch jobs that commit them."""
