"""seqloom: sequence matching, learner analytics and corpus preparation on Spark."""
